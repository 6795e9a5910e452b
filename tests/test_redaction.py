import json

from pyspark.sql import functions as F

from lumenspar.operators import pipeline, redaction

CASES = [
    ("login with passwd: q1 and more", "login with passwd: [REDACTED] and more"),
    ("{'private-key': 'a b', 'x': 1}", "{'private-key': '[REDACTED]', 'x': 1}"),
    ("proxy-authorization = Digest q9/z, ok", "proxy-authorization = [REDACTED], ok"),
    ("https://h.test/v?sig=Zz&page=3#top", "https://h.test/v?sig=[REDACTED]&page=3#top"),
    ('"card_number"=>"4111 1111", "n"=>2', '"card_number"=>"[REDACTED]", "n"=>2'),
    ("set x.cookie=1; authtokens: 2", "set x.cookie=[REDACTED]; authtokens: [REDACTED]"),
    ('note="secret=s1"', 'note="secret=[REDACTED]"'),
    ("to ann.lee+x@mail.example.org now", "to [REDACTED] now"),
    ("phones_x=1 secretary: 2 tokens_used=3 api.key=4 monkey=5", None),
    ('api-key="never closed', None),
    ("the cookie: ", None),
    ("", None),
    (None, None),
    ("é" * 20_000 + " cvc=1", "é" * 20_000 + " cvc=[REDACTED]"),
    ("a=b " * 20_000, None),
]


def test_both_forms_agree_and_are_idempotent(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(CASES)], "i int, m string")
    once = df.select("i", pipeline.redact(F.col("m")).alias("m"))
    got = dict(once.collect())
    for i, (m, want) in enumerate(CASES):
        assert got[i] == (want if want is not None else m), m
        assert m is None or redaction.redact_text(m) == got[i]
    assert dict(once.select("i", pipeline.redact(F.col("m"))).collect()) == got
    assert df.select(pipeline.redact(F.col("m"), ((r"\bq(\d)", "Q$1"),)).alias("m")).where("m like '%Q9%'").count() == 0


def test_attributes_keep_their_spelling(spark):
    rows = [
        ('{"note":"password=hunter2 mail a@b.io"}', '{"note":"password=[REDACTED] mail [REDACTED]"}'),
        ('{ "APIKey" : {"a":[1]}, "b" : ["me@x.org",{"refreshToken":1}], "n":1.50 }', '{ "APIKey" : "[REDACTED]", "b" : ["[REDACTED]",{"refreshToken":"[REDACTED]"}], "n":1.50 }'),
        ('{"pa\\u0073sword":"x","k":"q\\"@","e":"\\u00fc a@b.io"}', '{"pa\\u0073sword":"[REDACTED]","k":"q\\"@","e":"\\u00fc [REDACTED]"}'),
        ('{"token_count":5,"microphone":"on"}', None), ("[1]", None), ("{x", None), ("{}", None), ("", None), (None, None), ("[" * 5000, None), ('{"a":{"password":{"b":[{}]}},"c":"d@e.fr"}', '{"a":{"password":"[REDACTED]"},"c":"[REDACTED]"}'),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string")
    got = dict(df.select("i", pipeline.redact_attrs(F.col("a"))).collect())
    for i, (a, want) in enumerate(rows):
        assert got[i] == (want if want is not None else a)
        if want:
            json.loads(got[i])


def test_every_severity(spark):
    want = {"exception": "error", " WARN ": "warn", "35": "warn", "45": "error", "55": "critical", "15": "debug", "8": "info", "61": "info", "-1": "info", "7": "debug", "fine": "debug", "x": "info", "": "info"}
    got = spark.createDataFrame([(k,) for k in want], "k string").select("k", pipeline.severity(F.col("k"))).collect()
    assert {a: b for a, b in got} == want
    assert spark.createDataFrame([(None,)], "k string").select(pipeline.severity(F.col("k"))).first()[0] == "info"
