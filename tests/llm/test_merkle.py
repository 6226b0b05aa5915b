import hashlib
import random
import re

import pytest
from edge import DOCS, awkward, docs, rows, words
from pyspark.sql import functions as F

from fleetlens.llm.merkle import PARAGRAPH, SECTION, SENTENCE, likeness, locate_edits, neighbour_fingerprints, with_fingerprint

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_print(text):
    digests, shown = [], []
    for section in re.findall(SECTION, text):
        paragraphs = [re.findall(SENTENCE, p) for p in re.findall(PARAGRAPH, section)]
        assert "".join(map("".join, paragraphs)) == section
        digests.append(sha("".join(sha(",".join(f"{sha(s)}-{len(s)}" for s in p)) for p in paragraphs)))
        shown.append(f"{digests[-1][:12]}=" + "/".join(",".join(f"{sha(s)[:8]}-{len(s)}" for s in p) for p in paragraphs))
    return sha("".join(digests)) + ":" + ";".join(shown)


def brute_near(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    a, b = (set(re.findall("[0-9a-f]{8}-[0-9]+", x)) for x in (a, b))
    size = lambda s: sum(int(x.split("-")[1]) for x in s)
    return 2.0 * size(a & b) / (size(a) + size(b))


def brute(data):
    order = sorted(((i, t or "") for i, t in data), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, text) in enumerate(order):
        following = order[k - 1][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        fp, efp, nfp = brute_print(text), brute_print(edited), brute_print(following)
        out.append((i, len(text), text, edited, fp, nfp, efp, brute_near(fp, efp), brute_near(fp, nfp)))
    return sorted(out, key=str)


def prose(seed, lines=None):
    rng = random.Random(seed)
    return "\n".join(" ".join(rng.choice(["alpha", "beta.", "gamma!", "delta", "漢字。", "x"]) for _ in range(rng.randrange(0, 30))) for _ in range(lines or rng.randrange(1, 12)))


COLUMNS = ["doc_id", "n_chars", "text", "edited", "fingerprint", "next_fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("per", [100_000, 7, 1])
def test_against_brute_force(spark, per):
    data = awkward() + [(100 + 3 * i, prose(i)) for i in range(150)] + [(900, "\n\n\n"), (901, "a.\n\nb"), (902, "." * 500), (903, "y" * 500)]
    assert rows(neighbour_fingerprints(docs(spark, data), rows_per_range=per), *COLUMNS) == brute(data)


def test_one_document_follows_itself(spark):
    assert rows(neighbour_fingerprints(docs(spark, [(5, "abcd")])), *COLUMNS) == brute([(5, "abcd")])


def test_equal_roots_and_likeness(spark):
    data = [(1, prose(1)), (2, prose(1)), (3, prose(1) + "!"), (4, "")]
    got = {r.doc_id: r.f for r in with_fingerprint(docs(spark, data, False), "text", "f").collect()}
    assert got[1] == got[2] and got[1].split(":")[0] != got[3].split(":")[0]
    pairs = spark.createDataFrame([(got[1], got[2]), (got[1], got[3]), (got[1], got[4])], "a string, b string")
    near = [r.n for r in pairs.select(likeness(F.col("a"), F.col("b")).alias("n")).collect()]
    assert near[0] == 1 and 0.5 < near[1] < 1 and near[2] == 0


def test_edits_are_located(spark):
    old = "\n".join(f"sentence number {i} of the old text. It has a second one {i}" for i in range(40))
    new = old.replace("number 20 of the old", "number 20 of the new")
    pair = docs(spark, [(1, old)], False).withColumn("new", F.lit(new))
    prints = with_fingerprint(with_fingerprint(pair, "text", "a"), "new", "b")
    found = {r.side: (r.start, r.end) for r in locate_edits(prints, "doc_id", "a", "b").collect()}
    assert old[slice(*found["before"])] == "sentence number 20 of the old text." and new[slice(*found["after"])] == "sentence number 20 of the new text."
    assert locate_edits(prints, "doc_id", "a", "a").count() == 0


def test_no_python_in_the_plan(spark):
    plan = neighbour_fingerprints(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|SinglePartition.*Window", plan)


def test_empty_table(spark):
    assert rows(neighbour_fingerprints(spark.createDataFrame([], DOCS)), "doc_id") == []


def test_words_are_covered():
    for text in [words(300, 1), "\n", ".\n.", "a\n \n\nb"]:
        assert "".join(re.findall(SECTION, text)) == text
