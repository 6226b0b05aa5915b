import re

from edge import DOCS, awkward, docs, rows, words

from fleetlens.llm.line_dedup import line_dedup


def _norm(line):
    return re.sub(r"[ \t\n\r\x0b\x0c]+", " ", line).strip(" ").lower()


def units(text):
    """(line, start, end) of every sentence, character by character."""
    out, start, line, ended = [], 0, 0, False
    for at, c in enumerate(text + "\n"):
        if c == "\n" or (ended and c not in ".!?。！？"):
            if at > start:
                out.append((line, start, at))
            start, ended = at, False
        if c == "\n":
            line, start = line + 1, at + 1
        elif c in ".!?。！？":
            ended = True
    return out


def brute(data, least=20):
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, text in data:
        for _, a, b in units(text or ""):
            n = _norm(text[a:b])
            if len(n) >= least:
                first[n] = min(first.get(n, (rank(i), a)), (rank(i), a))
    out = []
    for i, text in data:
        text = text or ""
        found = units(text)
        goes = {(a, b) for _, a, b in found if len(n := _norm(text[a:b])) >= least and first[n] != (rank(i), a)}
        lines = []
        for k, raw in enumerate(text.split("\n")):
            own = [(a, b) for line, a, b in found if line == k]
            if not raw or set(own) - goes:
                lines.append("".join(text[a:b] for a, b in own if (a, b) not in goes))
        out.append((i, "\n".join(lines), len(found), tuple(sorted(goes))))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.text, r.n_units, tuple((g.start, g.end) for g in r.removed)) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    shared = [words(60, s) for s in range(4)]
    data = awkward() + [
        (100, f"{shared[0]}\n\nunique line of five words\n{shared[1]}\nshort\nshort"),
        (101, f"short\n  {shared[0].upper()} \n{shared[2]}\n{shared[2]}"),
        (99, f"é{words(9, 9)}\n{shared[1]}\n\n\n{shared[3]}"), (102, f"{words(9, 9)}\n" * 40),
        (103, f"An own start. {shared[0]}. And an end of its own!?"), (104, "\n\n"), (105, f"{shared[2]}..."), (106, f"{shared[2]}...\n"),
        (107, "这是一个没有空格的很长的句子它会在别的文本里重复出现一次。另一句话"), (108, "前言。这是一个没有空格的很长的句子它会在别的文本里重复出现一次。"),
    ]
    assert found(line_dedup(docs(spark, data))) == brute(data)
    assert found(line_dedup(docs(spark, data), min_chars=1)) == brute(data, 1)


def test_a_passage_spliced_into_a_line_goes(spark):
    passage = " ".join(f"This is sentence {i} of a passage that repeats." for i in range(12))
    data = [(1, f"One start. {passage} One end."), (2, f"Another start without an end mark {passage} Another end."), (3, "汉字" * 30 + "。"), (4, "序。" + "汉字" * 30 + "。")]
    left = {r.doc_id: r.text for r in line_dedup(docs(spark, data)).collect()}
    assert left[1] == data[0][1] and len(left[2]) < 120 and "sentence 5" not in left[2] and left[4] == "序。"


def test_offsets_point_into_the_original(spark):
    line = words(55, 1)
    out = line_dedup(docs(spark, [(1, line), (2, f"ü\n{line}\nx")])).where("doc_id = 2").first()
    cut = out.removed[0]
    assert f"ü\n{line}\nx"[cut.start : cut.end] == line and (cut.first_doc, cut.first_unit) == (1, 0)
    assert out.text == "ü\nx" and out.n_chars == 3


def test_empty_table(spark):
    assert rows(line_dedup(spark.createDataFrame([], DOCS)), "doc_id") == []
