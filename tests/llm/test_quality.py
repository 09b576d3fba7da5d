import random
import re
from collections import Counter

from pyspark.sql import functions as F

from factsieve.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def texts():
    rng = random.Random(2)
    sea = ["a", "b", "c", "d*", "é😀", "#1", "&", "f\x0bg"]
    return [(i, rng.choice([" ", "\n", " \r\n"]).join(rng.choice(sea[: rng.choice((2, 8))]) for _ in range(rng.choice((0, 1, 2, 3, 9, 60))))) for i in range(120)] + [(200, None), (201, " \t\n"), (202, "x\n x\nx\n\nx"), (203, "a b c " * 4000)]


def test_counts_against_a_plain_version(spark):
    rows = texts()
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), []).where("n_words >= 0 and kept is not null").collect()
    for r in got:
        want = brute(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (r, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept != r.base_failed
    assert len(got) == len(rows)


def test_rules_are_learned_in_order(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        f = {n: rng.random() for n in quality.FEATURES}
        bad = (f["symbol_share"] > 0.8) or (f["upper_share"] > 0.5 and f["mark_share"] > 0.7)
        rows.append((int(bad), rng.random() < 0.33, *f.values()))
    table = spark.createDataFrame(rows, f"bad int, held boolean, {', '.join(f'{n} double' for n in quality.FEATURES)}")
    rules = quality.learn(table, precision=0.9)
    assert 2 <= len(rules) <= 6
    met = table.withColumn("rule", quality.verdict(rules)).where("not held").groupBy((F.col("rule") > 0).alias("said")).agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    by = {r.said: (r.bad, r.n) for r in met.collect()}
    assert by[True][0] > 0.93 * by[True][1] and by[False][0] < 0.1 * by[False][1]
    first = table.where(rules[0].column()).count()
    assert table.where(quality.verdict(rules) == 1).count() == first > 0


def test_nothing_to_learn(spark, awkward, no_rows):
    labels = spark.createDataFrame([(None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    assert quality.learn(quality.labelled(awkward, labels)) == []
    assert quality.learn(quality.labelled(no_rows, labels.limit(0))) == []
    got = quality.judge(awkward, [])
    assert got.columns[:5] == ["doc_id", "lang", "source", "n_chars", "n.words"] and got.count() == awkward.count()
    assert quality.judge(no_rows, []).count() == 0
