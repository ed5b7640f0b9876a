"""Edit distances and line classes against plain Python, and the defined results."""

import random

import pytest

from pagemark.llm import lines


def distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            text.insert(at, rng.choice("abé漢"))
        elif text[at:]:
            text[at:at + 1] = [] if kind == 1 else [rng.choice("abé漢")]
    return "".join(text)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "a"), ("abc", "")]
    for size in [*range(9), 40, 70, 300]:
        for _ in range(30):
            a = "".join(rng.choices("abé漢", k=size))
            pairs.append((a, edited(rng, a, rng.randrange(edits + 3))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", lines.edit_distance("a", "b", edits).alias("d")).collect()
    for r in got:
        want = distance(r.a, r.b)
        assert r.d == want if want <= edits else r.d > edits, (r.a, r.b, r.d, want)


def plain_classes(rows, edits, min_chars):
    places = {}
    for doc_id, text in rows:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line) >= min_chars:
                places.setdefault(line, set()).add((doc_id, at))
    parent = {line: line for line in places}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in places:
        for b in places:
            if a < b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                parent[top(a)] = top(b)
    classes = {}
    for line, own in places.items():
        classes.setdefault(top(line), set()).update(own)
    return {place: min(own) for own in classes.values() for place in own}


@pytest.mark.parametrize("edits", [1, 2])
def test_classes(spark, edits):
    rng = random.Random(edits)
    pool = ["".join(rng.choices("abcdefgh ", k=rng.randrange(1, 45))) for _ in range(25)]
    rows = []
    for doc_id in range(60):
        own = [edited(rng, rng.choice(pool), rng.choice((0, 1, 1, 2, 4))) for _ in range(rng.randrange(6))]
        rows.append((doc_id, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 5000), (104, "x" * 5001), (105, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.line_classes(docs.repartition(3), edits, min_chars=10).collect()
    want = plain_classes(rows, edits, 10)
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == want
    assert len(got) == len(want)
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)) for r in got)
    assert len(set(want.values())) < len(want)


def test_dedupe(spark):
    a, b = "a line that is long enough", "another line of some length"
    rows = [(1, f"{a}\nok\n{b}", "p"), (2, f"{a}.\nok", "q"), (3, b, "r"), (4, None, "s"), (5, "", None),
            (6, f"new text that stands alone\n{a}\n{a}", "t"), (1, f"{a}\nok\n{b}", "p"), (None, f"{b}!", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line_no string")
    got = lines.dedupe_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, f"{a}\nok", "p"), (2, "ok", "q"), (3, "", "r"), (4, None, "s"), (5, "", None),
        (6, "new text that stands alone", "t"), (1, f"{a}\nok", "p"), (None, f"{b}!", "n")]))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_classes(docs).collect() == [] == lines.dedupe_lines(docs).collect()


def test_texts_through_a_shuffle(spark):
    rows = [(i, f"one line with number {i} in it here") for i in range(8)]
    own = lines.eligible_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert lines.link_lines(own, broadcast_rows=0).count() == 8


@pytest.mark.parametrize("edits", [1, 2])
def test_crowded_keys_lose_no_link(spark, monkeypatch, edits):
    """Every key counts as crowded, so all pairs go through the extended keys."""
    rng = random.Random(edits + 7)
    monkeypatch.setattr(lines.candidates, "__defaults__", (lines.EDITS, 1, lines.LEVELS))
    pool = ["https://example.test/a/" + "".join(rng.choices("abc", k=rng.randrange(4, 30))) for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.choice((0, 1, 2, 3))) for _ in range(5))) for i in range(50)]
    got = lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string"), edits, min_chars=10).collect()
    want = plain_classes(rows, edits, 10)
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == want


def test_shared_prefix_does_not_make_all_pairs(spark, monkeypatch):
    met = {}
    settled = lines.settle

    def counting(df, name):
        out = settled(df, name)
        if name == "line-across":
            met[size] = out.count()
        return out

    monkeypatch.setattr(lines, "settle", counting)
    rng = random.Random(5)
    for size in (500, 4000):
        texts = ["https://archive.example.test/" + "".join(rng.choices("abcdefghij", k=40)) for _ in range(size)]
        texts += [t[:-1] + "!" for t in texts[:20]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        classes = lines.line_classes(docs).collect()
        assert len({r.class_id for r in classes}) == size and sum(not r.kept for r in classes) == 20
    assert met[4000] <= 10 * max(met[500], 40)  # all pairs would be 64 times as many
