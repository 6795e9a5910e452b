import random
import time

import pytest

from lumenspar.llm.sentences import LONG, _short, best_spans, sentences, split_sentences


@pytest.mark.parametrize(
    "want",
    [
        ["The window closed at 3 p.m. on Friday.", "By 07:40 it was at 60; by 3 p.m. it was gone."],
        ["Then Dr. Aalbeck moved it to the U.S. region.", "etcd lost its leader 9 times.", "872 of the shards never came back."],
        ["(The spool was never at risk.)", "Restart it, e.g. by hand.", "Really?!", "According to J. R. Tarnow, it was approx. 0.25 s."],
        ['The alert said: "No data for queue.depth. Check the agent."', "The fix in v0.9.12-rc.1 is small."],
        ["“The queue is full. Stop the writers,” wrote M. Holtvik in the channel.", "“Is it the disk?” asked Mr. Quillmoor.", "Inc. 548 and inc. 726 share one cause, viz. the clock."],
        ["It answered with 503 ... then it went quiet.", "A storm filled the spool…", "etcd stalled."],
        ["The probe hit :8080/healthz?full=1 and got 732 bytes.", "See https://wiki.example.test/ops/spool.html?x=1.5 for more."],
        ["„Die Warteschlange ist voll. Bitte anhalten“, schrieb Frau Tarnow.", "Im 2. Quartal sank der Anteil auf 99,95 Prozent.", "Man kann z. B. agent.yaml anpassen."],
        ["« La file est pleine. Arrêtez tout », a écrit l'équipe.", "Ne touchez pas à limits.toml !", "On garde les mesures pendant 68 jours, etc.", "Mme Tarvel a vidé la file."],
        ["¡No reinicie a mano!", "«La cola está llena. Paren todo», escribió la guardia.", "Según la Dra. Olmo, EE. UU. perdió 740 muestras.", "¿Por qué falla?"],
        ["По словам А. Б. Лунева, помогла версия v3.0.", "Файл main.go правили в 2025 г. и больше не трогали.", "Метрики хранятся 9 дней и т. д., см. рис. 9."],
        ["डॉ. मेहरान ने कहा कि main.go बदलना होगा।", "विलंब 1.04 सेकंड तक बढ़ गया।"],
        ["قال د. سامر إن الطابور ممتلئ.", "لماذا لا تستجيب api؟"],
    ],
)
def test_spaced_scripts(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


@pytest.mark.parametrize("want", [["值班员写道：“队列满了。先停写入。”然后重启了api。", "版本16.15修复了缺口……", "谁负责？", "请不要手动重启！"], ["「キューが満杯です。止めてください。」と当番が書いた。", "v2.14.3でnet.rxの欠測が直った。", "担当は誰ですか？"]])
def test_unspaced_scripts(want):
    text = "".join(want)
    assert [text[a:b] for a, b in sentences(text)] == want


def test_layout():
    text = "One line\nwraps here. Two.Three stays.\n- item one\n- Item one. Item two.\nAfter.\n\n## 3. Head of it. All\n    level=warn msg=\"No data. Retrying.\"\n\n  lead\n \n\nend"
    assert [text[a:b] for a, b in sentences(text)] == ["One line\nwraps here.", "Two.", "Three stays.", "- item one", "- Item one.", "Item two.", "After.", "## 3. Head of it. All", 'level=warn msg="No data. Retrying."', "lead", "end"]
    th = "คิวว่างภายใน67วินาที ใครดูแลบริการนี้อยู่ โหนด63เสียข้อมูลร้อยละ48.0\nบริการหยุดทำงาน"
    assert [th[a:b] for a, b in sentences(th)] == [*th.split("\n")[0].split(" "), th.split("\n")[1]]


def test_a_stray_quotation_costs_one_span():
    text = 'He said "stop. Then he left. ' + "Nobody came. " * 5 + "The end."
    got = [text[a:b] for a, b in sentences(text)]
    assert got[-6:] == ["Nobody came."] * 5 + ["The end."]


def test_spans_cover_everything_but_white_space(spark):
    texts = ["A b. C d!\n\nE", "", None, "   \n ", ". . .", "x" * 200_000, "word. " * 20_000, '"' * 50, "a\r\nb."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id bigint, text string")
    got = {}
    for r in split_sentences(df.limit(len(texts)), with_text=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"], r["sentence"]))
    for i, t in enumerate(texts):
        spans = sorted(got.get(i, []))
        assert all(t[a:b] == s and s == s.strip() and s for a, b, s in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        covered = "".join(s for _, _, s in spans)
        assert "".join(covered.split()) == "".join((t or "").split())
    assert len(got[6]) == 20_000
    assert split_sentences(df).count() == sum(map(len, got.values())) + len(got[0])
    assert split_sentences(df.where("false")).count() == 0


def units(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize("n", [1, 5, 6, 40, 300])
@pytest.mark.parametrize(("a", "b"), ['""', "“”", "„“", "«»", "()", "「」"])
def test_a_quotation_of_any_length_stays_with_its_sentence(n, a, b):
    inner = " ".join("All of it stopped." for _ in range(n))
    assert units(f"He said: {a}{inner}{b} and left. Nobody asked.") == [f"He said: {a}{inner}{b} and left.", "Nobody asked."]


@pytest.mark.parametrize("n", [63, 64, 70, 150, 1000])
def test_no_cap_on_the_candidates_of_a_sentence(n):
    long = "It ran " + "at 3 p.m. and " * n + "then stopped."
    assert units(f"{long} It was late.") == [long, "It was late."]


def test_time_is_linear_in_marks_and_boundaries():
    def seconds(text):
        t = time.process_time()
        sentences(text)
        return time.process_time() - t

    for piece in ('He said "no. Not now." once. ', "(a. b) c. ", '"', "“x. ", "a.", "Mr. ", "« a. ", '5" wide. ', "x) y. "):
        small, large = piece * 4_000, piece * 100_000
        seconds(small)
        assert seconds(large) < 60 * max(seconds(small), 0.01), piece


def test_stray_marks():
    assert units('A 5" pipe burst. A 7" one held. All fine.') == ['A 5" pipe burst.', 'A 7" one held.', "All fine."]
    assert units('He said "stop. Then he left. She said "go. Now." and "No. Never." at last. End.')[-2:] == ['She said "go. Now." and "No. Never." at last.', "End."]
    assert units("It (was fine. Then :) it broke.") == ["It (was fine. Then :) it broke."]
    assert units("1) One. 2) Two. Done.") == ["1) One.", "2) Two.", "Done."]


def test_the_programme_finds_the_best_spans():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        cut = sorted(rng.sample(range(1, 1500), 2 * n - 1)) + [1500]
        begins, ends = [0, *cut[1:-1:2]], cut[::2]
        gain = [rng.choice([-6, -1, 0.5, 2, 4]) for _ in range(n - 1)] + [0]
        text = "".join(rng.choice("a. ") for _ in range(1500))

        def score(spans):
            at = {e: i for i, e in enumerate(ends)}
            return sum(gain[at[b]] + (_short(text, a, b) if b - a < 4 else -max(0, b - a - LONG) / LONG) for a, b in spans)

        every = []
        for mask in range(1 << (n - 1)):
            stops = [j for j in range(n - 1) if mask >> j & 1] + [n - 1]
            starts = [0, *(j + 1 for j in stops[:-1])]
            every.append(score([(begins[i], ends[j]) for i, j in zip(starts, stops)]))
        assert score(best_spans(text, begins, ends, gain)) == pytest.approx(max(every))
