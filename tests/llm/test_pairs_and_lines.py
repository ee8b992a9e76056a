"""Jaccard join, line dedup, decontamination against brute force and SQL, with the awkward rows of each."""

import hashlib
import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from weeklark.llm import decontam, jaccard, linededup
from weeklark.llm.common import Scratch
from weeklark.llm.components import components

AWKWARD = [
    (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "one"), (905, "One"), (906, "a b c d e"), (907, "A B C D E"), (908, "x" * 50_000),
    (909, " ".join(f"w{i}" for i in range(9000))), (910, " ".join(f"w{i}" for i in range(9000)) + " end"), (911, "\x1cone two\x1c three"),
]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def corpus(seed=1, n=120):
    """Unlike texts, near copies of a few, exact copies, and passages that many share."""
    r = random.Random(seed)
    words = [f"t{i}" for i in range(800)]
    passages = [" ".join(r.choices(words, k=60)) for _ in range(3)]
    bases = [" ".join(r.choices(words, k=r.randint(20, 220))) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45:
            ws = r.choice(bases[:4]).split()
            for _ in range(r.randint(0, 3)):
                ws[r.randrange(len(ws))] = r.choice(words)
            text = " ".join(ws)
        elif kind < 0.7:
            text = r.choice(passages) + " " + " ".join(r.choices(words, k=r.randint(1, 60)))
        elif kind < 0.8:
            text = r.choice(bases)
        else:
            text = " ".join(r.choices(words, k=r.randint(1, 150)))
        rows.append((i, text))
    return rows


def by_brute_force(rows):
    sets = {}
    for doc, text in rows:
        ws = (text or "").encode().lower().split()
        sets[doc] = {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("settings", [{}, {"HOT": 2, "CELL": 4, "DEAL": 5, "LEADERS": 1, "BLOCK": 3}, {"HOT": 1, "LEADERS": 0}, {"HOT": 2, "GATHER": 40, "DEAL": 3}, {"HOT": 1, "LEADERS": 0, "RUN": 3, "BLOCK": 2, "PART_BYTES": 200}, {"HOT": 1, "LEADERS": 0, "RUN": 10, "PART_BYTES": 5000}])
def test_jaccard_matches_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus() + AWKWARD
    random.Random(2).shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == by_brute_force(rows)


def test_jaccard_run_of_one_more_than_a_block(spark):
    # 34 of 40 shingles are common to all, so that their runs have all sets and reach into the index; none of them link (34/46).
    base = [f"w{i}" for i in range(42)]
    rows = [(i, " ".join([*base[:20], f"x{i}", *base[20:], f"y{i}"])) for i in range(jaccard.BLOCK + 1)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (40, i) for i, _ in rows}


@pytest.mark.parametrize("block", [1, 2, 4, 12])
def test_jaccard_pairs_do_not_depend_on_the_block(block):
    draw = random.Random(5)
    rows = [(i, i, 20, sorted({7, *draw.sample(range(8, 20), 5)}), 4) for i in range(13)]
    found = lambda size: {(i, j) for x, y in jaccard._Run(7, rows).pairs(size) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert found(block) == found(100) and found(100)
    across = lambda size: {(i, j) for x, y in jaccard._Run(7, rows).pairs(size, 5) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert across(block) == {(i, j) for i, j in found(100) if i < 5 <= j}


def test_long_runs_are_let_go_and_counted_alike():
    """Any size of what is held gives the same pairs and the same counts of frequent tokens."""
    r = random.Random(6)
    drawn = {(r.randint(0, 6), r.randint(0, 14), r.randint(0, 60)): r.randint(0, 1) for _ in range(900)}
    rows = [(token, cell, cell // 4, info, cell * 100 + rep) for (token, cell, rep), info in sorted(drawn.items(), key=lambda x: (x[0][0], x[0][1], -x[1]))]
    rows += [(7, 1, 0, 1, 100 + i) for i in range(40)] + [(8, c, 9, 1, c) for c in range(50)] + [(9, c, c, 0, c) for c in range(50)] + [(10, c, c, 1, c) for c in range(30)]
    rows += [(11 + t, c, c // 2, 1, c * 100 + i) for t in range(4) for c in range(5 + t) for i in range(9)]

    def found(gather, size):
        batches = [jaccard._rows([list(c) for c in zip(*rows[i:i + size])], (jaccard.pa.int64(),) * 5, ["token", "cell", "grp", "info", "rep"]) for i in range(0, len(rows), size)]
        out = {}
        for batch in jaccard._common_tokens(12, gather)(iter(batches)):
            for ca, cb, n in zip(*(c.to_pylist() for c in batch.columns)):
                out[ca, cb] = out.get((ca, cb), 0) + n
        return out

    whole = found(10**6, len(rows))
    assert any(b is None for _, b in whole) and any(b is not None for _, b in whole)
    assert all(found(gather, size) == whole for gather, size in [(10, 7), (30, 100), (5, 1), (200, 33)])


def test_jaccard_repeated_null_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 2, 1), (True, 0, 2, None)]
    assert jaccard.near_duplicates(frame(spark, []).limit(0)).count() == 0
    kept = jaccard.keep_one(frame(spark, rows, "doc_id bigint, text string").withColumn("component_id", F.lit("mine")))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"] and kept.columns == ["doc_id", "text", "component_id"]


def test_threshold_is_exact(spark):
    # 8 and 6 shingles of which 6 are common: 6/8 is 75 in a hundred.
    a, b = "a b c d e f g h i j k l", "a b c d e f g h i j"
    c = "a b c d e f g h i"
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, [(1, a), (2, b), (3, c)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1}  # 3 links with 2 (5/6) though not with 1 (5/8)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, [(1, a), (3, c)])).collect()}
    assert got == {1: 1, 3: 3}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)]
    random.Random(3).shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(20, 60)]}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


LINE = "This line is long enough to count as one, since it has over forty signs"


def lines_by_hand(rows):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\r\x0b\x0c"))
    held = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(doc)
    out = {}
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != doc)]
        out[doc] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_match_by_hand(spark):
    r = random.Random(5)
    pool = [LINE, LINE.upper() + "\t", " " + LINE, "É" + LINE, "é" + LINE, "short", "", "x" * 39, "é" * 40, "é" * 39 + " ", LINE + " two", "\x1c" + LINE]
    rows = [(i * 7, "\n".join(r.choices(pool, k=r.randint(1, 6)))) for i in range(60)] + [(1000, None), (1001, ""), (1002, LINE + "\n" + LINE), (1003, "y" * 100_000)]
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in linededup.digest(linededup.dedup_lines(frame(spark, rows))).collect()}
    assert got == lines_by_hand(rows)
    assert linededup.dedup_lines(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_common_lines_beyond_a_broadcast(spark, monkeypatch, batches):
    """Common and other keys by separate joins, uneven ids, any number of batches."""
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 10)
    r = random.Random(batches)
    pool = [f"{LINE} {i}" for i in range(12)]
    rows = [(i if i < 900 else 2**62 + i, "\n".join([LINE, *r.choices(pool, k=2)])) for i in range(1100)]
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in linededup.digest(linededup.dedup_lines(frame(spark, rows), batches=batches)).collect()}
    assert got == lines_by_hand(rows)


def test_runs_are_read_without_a_shuffle(spark):
    store = linededup.LineRuns(Scratch(spark, "runs"), fanout=3, buckets=4)
    for batch in [[(9, b"a"), (8, b"b")], [(6, b"a")]]:
        store.add(spark.createDataFrame(batch, "doc_id bigint, key binary"))
    plan = store.frequent(1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_lines_null_ids_and_clashing_columns(spark):
    rows = [(i, LINE, "x") for i in range(6)] + [(None, LINE, "x")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out if r["text"]) == [("5", LINE), ("None", LINE)]
    assert len(out) == 7


def test_runs_compact_and_keep_counts(spark):
    store = linededup.LineRuns(Scratch(spark, "runs"), fanout=2)
    batches = [[(9, b"a"), (8, b"a"), (8, b"b")], [(6, b"a")], [(5, b"b"), (4, b"c")], [(3, b"a")], [(1, b"c")]]
    for batch in batches:
        store.add(spark.createDataFrame(batch, "doc_id bigint, key binary"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    got = {bytes(r["key"]): (r["n_docs"], r["keeper"]) for r in store.frequent(1).collect()}
    assert got == {b"a": (4, 9), b"b": (2, 8), b"c": (2, 4)}


ITEM = " ".join(f"q{i}" for i in range(20))


def decon_by_hand(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        ws = split(text)
        for i in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[i:i + 13]), set()).add("" if item is None else str(item))
    out = {}
    for doc, text in docs:
        ws, hit, found = split(text), set(), set()
        for w, owners in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= owners
        out[doc] = (len(ws), len(hit), len(found), decontam.sha_of(list(found)), bool(hit) and 20 * len(hit) >= len(ws))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 2000, 120])
def test_decontamination_matches_by_hand(spark, block):
    q = ITEM.split()
    items = [(1, ITEM), (10, "short item"), (2, None), (3, "..."), (4, ITEM + " more"), (5, "ÜBER alles hinaus"), (6, "short item"), (None, "short item"), (None, ITEM), (7, " ".join(f"z{i}" for i in range(90)))]
    docs = [
        (1, ITEM.upper()), (2, "filler " * 300 + " ".join(q[2:15])), (3, " ".join(q[:12])), (4, "a short, ITEM here"), (5, None), (6, ""), (7, "Über alles? hinaus"),
        (8, " ".join(q[:13]) + " " + " ".join(q[1:14])), (9, "short short item item short item"), (10, "w " * 20_000 + ITEM), (11, "über alles hinaus"), (12, "short item"),
    ]
    scanned = decontam.scan(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.digest(scanned).collect()}
    assert got == decon_by_hand(docs, items)


def test_a_hash_is_verified(monkeypatch):
    # All windows and words look alike: only their words tell them apart.
    monkeypatch.setattr(decontam, "_hashed", lambda words, at, n: decontam.np.zeros(len(at), decontam.np.uint64))
    monkeypatch.setattr(decontam, "_hash", lambda word: 1)
    found = decontam.NgramSet([("1", [b"a", b"b"]), ("2", [b"c", b"d"])], 2)
    marks, items = found.hits([b"x", b"c", b"d", b"a"])
    assert marks.tolist() == [False, True, True, False] and items == {"2"}


def test_blocks_are_bounded(spark):
    r = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(f"rare{r.random()}" for _ in range(r.choice([5, 60, 900])))) for i in range(60)], "item_id bigint, text string")
    blocks = list(decontam.blocks_of(items, block_bytes=20_000))
    longest = 13 * (25 + decontam.PER_WORD)
    assert len(blocks) > 10
    for block in blocks:
        assert len(pickle.dumps(decontam.NgramSet(block))) < 2 * 20_000 + longest + 4_000


def test_decontamination_removes_documents_or_spans(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Start, " + ITEM + "! End.", "x"), (2, "clean", "y"), (3, None, None)], "doc_id bigint, text string, items string")
    kept = decontam.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == docs.columns
    cut = {r["doc_id"]: (r["text"], r["items"]) for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: ("Start, ! End.", "x"), 2: ("clean", "y"), 3: (None, None)}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 3
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
