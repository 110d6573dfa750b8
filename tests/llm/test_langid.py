"""Language ID: rejection of what was not learned, the bounded sample, and a plain scorer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.llm import langid
from treeweave.runtime import table

FOREIGN = [
    "Hyvää päivää, tänään on kaunis ilma ja me menemme kävelylle metsään lasten kanssa", "Dzień dobry, dzisiaj jest piękna pogoda i idziemy na spacer do lasu z dziećmi",
    "Buongiorno, oggi è una bella giornata e andiamo a fare una passeggiata nel bosco con i bambini", "Bom dia, hoje está um dia bonito e vamos passear na floresta com as crianças",
    "Jó napot, ma szép idő van és elmegyünk sétálni az erdőbe a gyerekekkel", "Goedemorgen, vandaag is het mooi weer en wij gaan met de kinderen wandelen in het bos",
    "asdkjh qwe lkjzxc mnbvqwe poiuy zxcvbn qwerty asdfgh lkjhgf mnbvcx", "Привет, как дела? Сегодня хорошая погода", "今天天气很好我们去公园散步",
    'function foo(bar) { var x = document.getElementById("y"); for (let i = 0; i < x.length; i++) { console.log(x[i]); } return null; }',
]


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where(~langid.held_out())
    return langid.train(langid.labelled_sample(docs, "doc_id", "text", "lang"))


def test_what_was_not_learned_is_rejected(model):
    assert [model.predict(t)[2] for t in FOREIGN] == [False] * len(FOREIGN)


def test_what_was_learned_is_kept(spark, model):
    rows = table(spark, "/root/testdata/sf0.01", "documents").where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").collect()
    found = [(r["lang"], *model.predict(r["text"])) for r in rows]
    assert len(found) > 200
    assert sum(ok for *_, ok in found) >= 0.99 * len(found)
    assert sum(a == b for a, b, *_ in found) >= 0.99 * len(found)
    word = next(w for r in rows for w in r["text"].split() if len(w) > 4 and w.isalpha())
    assert model.predict(" ".join([word] * 300))[2]  # repeats of one word are one draw, not 300


def plain_subwords(text):
    """Subwords of runs of letters with a mark on either end, as tuples of code points."""
    marked, last = [0], True
    for c in text:
        if c.isalpha():
            low = c.lower()
            marked.append(ord(low) if len(low) == 1 else ord(c))
            last = False
        elif not last:
            marked.append(0)
            last = True
    marked.append(0)
    for n in langid.NGRAMS:
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if 0 not in g[1:-1] and any(g) and (n > 1 or g[0]):
                yield g


def plain_scores(model, text):
    total, n, seen, shown = np.zeros(len(model.languages)), 0, 0, 0
    for g in plain_subwords(text):
        h = 0
        for c in g:
            h = (h * 0x100000001B3 + c + 1) % 2**64
        x = (h * 0x9E3779B97F4A7C15 + len(g)) % 2**64
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        total += model.table[(x >> 40) % langid.BUCKETS]
        n += 1
        if len(g) in langid.EVIDENCE:
            at = x % (1 << langid.KNOWN_BITS)
            seen += int(model.evidence.bits[at // 8]) >> at % 8 & 1
            shown += 1
    z = np.exp((total / n - (total / n).max()) / model.temperature)
    return z / z.sum(), seen, shown


def test_plain_scorer_agrees(spark, sf, model):
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").collect() if r["text"] and len(r["text"]) < 4000]
    for t in [*FOREIGN, *texts, "a", "É é", "x1y2 z", "ab  cd"]:
        p, seen, shown = model._sums(t)
        want, s, k = plain_scores(model, t)
        assert p == pytest.approx(want, rel=1e-4, abs=1e-6) and (seen, shown) == (s, k), t[:60]


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, 'en', 'de') as lang", "repeat('some text ', 100) as text")
    got = langid.labelled_sample(docs, "doc_id", "text", "lang", most_bytes=100_000)
    assert 20 < len(got) <= 100 and {lang for _, lang, _ in got} == {"en", "de"}
    long = spark.range(3).selectExpr("id as doc_id", "'en' as lang", "if(id = 0, repeat('x', 2000000), 'text') as text")
    assert len(langid.labelled_sample(long, "doc_id", "text", "lang")) == 2


def test_few_labels_and_no_held_back_texts():
    model = langid.train([(0, "en", "the house of the people"), (0, "de", "das Haus der Leute")])
    assert 0 < model.threshold < 1 and not model.predict("qwxz pkvj zzqx")[2]
    one = langid.train([(i, "en", f"the house of the people and the river {i}") for i in range(50)])
    assert one.predict("the people of the house")[2] and not one.predict("Хорошая погода")[2]
