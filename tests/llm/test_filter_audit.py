import random
import re
from itertools import permutations

from unitloom.llm.filter_audit import audit

DOCS = "doc_id long, text string, source string, part string, n int, rid string, digest string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(doc_id, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows))


def brute(rows, labels):
    good, toxic = ({l[0] for l in labels if l[k] == 1 and l[0] is not None} for k in (1, 2))
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], set(fails(r[0], r[1], rows))) for r in rows if (r[2] or "") == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone, failing = [x for x in left if f in x[1]], [x for x in own if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                steps.append((
                    part, order, k + 1, len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f,
                ))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def sample():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [f"w{rng.randint(0, rng.choice([5, 3000]))}" for _ in range(rng.choice([0, 1, 199, 200, 260]))]
        words += ["#"] * rng.choice([0, 0, 1]) + ["ABCDEFGH"] * rng.choice([0, 0, 9])
        rng.shuffle(words)
        rows.append((3 * i, rng.choice([" ", "\n", "\t"]).join(words), rng.choice(["x", "y", None, ""])))
    rows += [(1000 + i, rows[rng.choice([4, 4, 4, 9, 17])][1], rng.choice(["x", "z"])) for i in range(60)]
    rows += [(None, rows[4][1], "x"), (None, None, "x"), (7, None, "y"), (8, "", "y"), (8, "", "y"), (9, "é中" * 50_000 + " A" * 3, "x"), rows[0], rows[0]]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None]), "p") for r in rows if rng.random() < 0.7]
    return rows, labels + [(None, 1, 1, "p"), (rows[0][0], 1, 1, "p"), (rows[0][0], 0, 0, "p"), (123456, 1, 1, "p")]


def test_every_order_equals_brute_force(spark):
    rows, labels = sample()
    docs = spark.createDataFrame([(*r, "q", 1, "r", "d") for r in rows], DOCS).repartition(5)
    got = audit(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = sorted(map(tuple, got.collect()))
    want = brute(rows, labels)
    assert len(found) == len(want) and found == want


def test_large_tables_join_hot_texts_apart(spark, monkeypatch):
    """The way beyond the broadcast limit gives the same rows."""
    import unitloom.llm.shared as shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(shared, "HOT_PARTS", 5)
    rows, labels = sample()
    got = audit(spark.createDataFrame([(*r, "q", 1, "r", "d") for r in rows], DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_no_documents_and_no_labels(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(none, labels).collect() == []
    one = audit(spark.createDataFrame([(1, None, None, None, None, None, None)], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}
    assert all((r.removed, r.kept) == ((1, 0) if "A" == r.filter_order[r.step - 1] else (0, int("A" not in r.filter_order[: r.step]))) for r in one)
