import random
import re

from pyspark.sql import functions as F

from treeloom.llm import licenses


def brute(text, sentences):
    """The longest sentence from each piece on, by trying all of them."""
    known = {}
    for i, s in sentences.items():
        known.setdefault(licenses.normalised(s), i)
    pieces = [p for p in map(licenses.normalised, re.split(licenses.BREAK, text or "")) if p]
    out, k = [], 0
    while k < len(pieces):
        best = (0, 0, 1)
        for m in range(1, len(pieces) - k + 1):
            run = " ".join(pieces[k : k + m])
            for words in {run, re.sub(licenses.ITEM, "", run)}:
                if words in known:
                    best = max(best, (len(words), known[words], m))
        out.append(best[1])
        k += best[2]
    return out


def ids(spark, texts, sentences):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    return [r.ids for r in df.select("i", licenses.sentence_ids(F.col("text"), sentences).alias("ids")).orderBy("i").collect()]


def test_overlapping_and_short_sentences_against_all_runs(spark):
    rng = random.Random(1)
    sentences = {i: " ".join(rng.choices("abcde", k=rng.randint(1, 5))) for i in range(1, 60)}
    sentences |= {100: "", 101: "1 a b"}
    texts = ["".join(rng.choice(["a", "b", "c", "d", "e", "12"]) + rng.choice([" ", " ", "\n", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "a b", "\n\n. ? !", "1 a b", "12\na\nb", "a" * 2000, "a\n" * 1000]
    assert ids(spark, texts, sentences) == [brute(t, sentences) for t in texts]
    assert ids(spark, texts, {1: "?!"}) == [brute(t, {}) for t in texts]


def test_a_thousand_sentences_and_a_text_full_of_them(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    sentences = {i: " ".join(rng.choices(words, k=rng.randint(3, 20))) for i in range(1, 1001)}
    wanted = [rng.randint(0, 1000) for _ in range(20000)]
    line = lambda i: sentences[i].title().replace(" ", rng.choice([" ", "\n", " * "])) if i else "Nothing known here."
    assert ids(spark, ["\n".join(map(line, wanted)), "no licence\n" * 30000], sentences) == [wanted, [0] * 30000]
