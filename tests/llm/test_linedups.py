import random
from collections import defaultdict

import numpy as np

from unitloom.llm.linedups import blocks, drop_shared_lines, heaviest_run, moved_blocks, patience, unspaced


def common_blocks(a, b, least):
    """Indexes in a of neighbouring lines with `least` words that b holds as neighbours, by all diagonals."""
    gone = set()
    for shift in range(-len(a) + 1, len(b)):
        run = []
        for i in range(len(a) + 1):
            if i < len(a) and 0 <= i + shift < len(b) and a[i] == b[i + shift]:
                run.append(i)
                continue
            if sum(len(a[k].split()) for k in run) >= least:
                gone |= set(run)
            run = []
    return gone


def expected(rows, block_words=20):
    """Every document against all earlier ones, without a choice of pairs."""
    own = {d: [(i, line.strip()) for i, line in enumerate((t or "").split("\n")) if line.strip()] for d, t in rows if d is not None}
    gone, known = defaultdict(set), {}
    for d in own:
        a = tuple(x for _, x in own[d])
        for e in own:
            b = tuple(x for _, x in own[e])
            if e < d and set(a) & set(b):
                if (a, b) not in known:
                    known[a, b] = common_blocks(a, b, block_words)
                gone[d] |= {own[d][k][0] for k in known[a, b]}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        text = t if not gone[d] else "\n".join(x for i, x in enumerate(lines) if i not in gone[d])
        out.append((d, text, 0 if t is None else len(lines), len(gone[d])))
    return sorted(out, key=str)


def test_removed_lines_equal_brute_force(spark, prose):
    rng = random.Random(8)
    pool = prose(80, seed=8, words=(1, 30))
    shared = [prose(4, seed=100 + i, words=(8, 30)) for i in range(8)]
    texts = []
    for i in range(150):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + prose(3, seed=1000 + i)
        rng.shuffle(lines)
        for block in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = ["  " + x + " \r" for x in block] if i % 5 == 0 else block
        texts.append("\n".join(lines))
    texts += [texts[4]] * 60 + [None, "", "\n\n", " ", "\n".join(pool), "\n".join(reversed(pool)), "\n".join(shared[0] * 300), "w " * 20_000]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (None, None), (8, texts[4])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gone string, n_lines int")
    got = drop_shared_lines(df)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == expected(rows)


def test_patience_keeps_order_and_joins_neighbours():
    assert patience("abcd", "abcd") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert patience("xabcy", "abcz") == [(1, 0), (2, 1), (3, 2)]
    assert patience("abxcd", "cdab") in ([(0, 2), (1, 3)], [(3, 0), (4, 1)])
    assert patience("aabaa", "caabaac") == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert patience("", "abc") == [] and blocks([], [], 1) == []


def test_no_rows(spark):
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def left_of(spark, rows):
    return {r.doc_id: r.text for r in drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_frequent_block_leads_to_its_own_first_holder(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(4)]
    alone = [(i + 1, f"start {i}\n{line}\nend {i}") for i, line in enumerate(lines)]
    many = [(100 + i, "\n".join([f"own line {i}", *lines, f"last line {i}"])) for i in range(40)]
    got = left_of(spark, alone + many)
    assert all(got[d] == t for d, t in alone + many[:1])
    assert all(got[100 + i] == f"own line {i}\nlast line {i}" for i in range(1, 40))


def test_short_lines_and_tails_of_blocks_go(spark):
    """Blocks of lines of two words; a short line after a long one that has another first holder."""
    verse = [f"word{i} more{i}" for i in range(12)]
    long, tail = " ".join(f"v{k}" for k in range(30)), "a short tail"
    rows = [(i, "\n".join([f"top {i}", *verse, f"end {i}"])) for i in range(30)]
    rows += [(50, long)] + [(60 + i, f"top {i}\n{long}\n{tail}\nend {i}") for i in range(20)]
    got = left_of(spark, rows)
    assert all(got[i] == f"top {i}\nend {i}" for i in range(1, 30))
    assert got[60] == f"top 0\n{tail}\nend 0" and all(got[60 + i] == f"top {i}\nend {i}" for i in range(1, 20))


def runs_of(lines, least=20):
    """Shortest runs of `least` words from and up to every line: {run: its line numbers}, by trying all."""
    out = defaultdict(set)
    for i in range(len(lines)):
        for step in (1, -1):
            j, words = i, 0
            while 0 <= j < len(lines) and words < least:
                words += len(lines[j].split())
                j += step
            if words >= least:
                run = range(min(i, j - step), max(i, j - step) + 1)
                out[tuple(lines[k] for k in run)] |= set(run)
    return out


def test_removed_lines_are_shared_with_earlier_documents_and_none_is_capped(spark, prose):
    """Blocks in one order: each line of a run that an earlier document holds goes, and no other."""
    rng = random.Random(9)
    blocks_ = [prose(rng.randint(1, 6), seed=200 + i, words=(1, 14)) for i in range(12)]
    rows = []
    for d in range(120):
        lines = []
        for k in sorted(rng.sample(range(12), rng.randint(1, 4))):
            lines += [f"own {d} {k} line", *[x for x in blocks_[k][rng.randint(0, 1) :] if x]]
        rows.append((d, "\n".join(lines)))
    got, earlier = left_of(spark, rows), set()
    for d, t in rows:
        own = t.split("\n")
        runs = runs_of(own)
        gone = set().union(*[places for run, places in runs.items() if run in earlier])
        assert got[d] == "\n".join(x for i, x in enumerate(own) if i not in gone)
        earlier |= set(runs)


def test_heaviest_run_equals_trying_all():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        cost = {x: rng.randint(1, 9) for x in "abc"}
        i, j, n = heaviest_run(a, b, [cost[x] for x in a])
        assert a[i : i + n] == b[j : j + n]
        runs = [a[p:q] for p in range(len(a)) for q in range(p + 1, len(a) + 1)]
        inside = [sum(cost[x] for x in r) for r in runs if any(b[k : k + len(r)] == r for k in range(len(b)))]
        assert sum(cost[x] for x in a[i : i + n]) == max(inside, default=0)
        pairs = patience(a, b)
        assert all(a[p] == b[q] for p, q in pairs) and all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))


def test_a_passage_that_the_earlier_document_repeats_goes(spark):
    passage = [" ".join(f"p{i}x{k}" for k in range(9)) for i in range(5)]
    rows = [(1, "\n".join(["z", *passage, "w", *passage, "v"]))] + [(10 + i, "\n".join([f"x {i}", *passage, f"y {i}"])) for i in range(20)]
    got = left_of(spark, rows)
    assert got[1] == rows[0][1] and all(got[10 + i] == f"x {i}\ny {i}" for i in range(20))


def test_scripts_without_blanks_and_lines_without_blanks_go(spark):
    signs = {"zh": range(0x4E00, 0x9FA0), "ja": range(0x3041, 0x30FF), "th": range(0x0E01, 0x0E2F), "b64": range(97, 123)}
    rng, rows, want = random.Random(6), [], {}
    for n, (name, chars) in enumerate(signs.items()):
        block = ["".join(chr(rng.choice(chars)) for _ in range(400 if name == "b64" else 14)) for _ in range(4)]
        for i in range(20):
            rows.append((100 * n + i, "\n".join([f"{name} {i}", *block, f"end {i}"])))
            want[100 * n + i] = f"{name} {i}\nend {i}" if i else rows[-1][1]
    assert left_of(spark, rows) == want


def test_unspaced_characters():
    for text, n in [("abc déß", 0), ("한국어 हिन्दी — “x”", 0), ("中文。", 2), ("カナ", 2), ("ไทย", 3), ("𠀀x", 1), ("", 0)]:
        assert unspaced(np.frombuffer(text.encode(), np.uint8)).sum() == n


def test_moved_blocks_go_too(spark):
    """Blocks in another order, a line that two places share, a block whose first holder is aligned otherwise."""
    one, two = ([" ".join(f"{c}{i}x{k}" for k in range(8)) for i in range(4)] for c in "pq")
    rows = [(1, "\n".join([*one, "middle", *two])), (2, "\n".join([*two, "between", *one])), (3, "\n".join([*one[:3], *two[1:], "own"]))]
    got = left_of(spark, rows)
    assert got == {1: rows[0][1], 2: "between", 3: "own"}


def test_moved_blocks_equal_all_diagonals():
    rng = random.Random(12)
    for _ in range(2000):
        a, b = (["".join(rng.choice("abcd") for _ in range(1)) for _ in range(rng.randint(0, 14))] for _ in "ab")
        words = [rng.choice([1, 4])] * len(a)
        aligned = blocks(patience(a, b, words, 6), words, 6)
        want = common_blocks([" ".join([x] * words[0]) for x in a], [" ".join([x] * (words or [1])[0]) for x in b], 6)
        assert set(moved_blocks(a, b, words, aligned, 6)) == want >= set(aligned)
