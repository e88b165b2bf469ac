import random
from collections import defaultdict

import duckdb
import numpy as np

from corpusloom.llm import passages
from corpusloom.llm.common import read_table


def exact_repeats(docs):
    """doc -> starts of 50-word windows that an earlier document has."""
    first, need = {}, defaultdict(set)
    for d in sorted(docs):
        for i in range(len(docs[d]) - 49):
            if first.setdefault(b" ".join(docs[d][i : i + 50]), d) != d:
                need[d].add(i)
    return need


def windows(words):
    """The sets of shingles of all windows of 50 words."""
    return [{tuple(words[k : k + 5]) for k in range(i, i + 46)} for i in range(len(words) - 49)]


def test_every_exact_repeat_is_found_and_every_finding_is_similar(spark):
    path = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in passages.repeats(read_table(spark, path, "documents")).collect()}
    texts = dict(duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall())
    docs = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    for d, starts in exact_repeats(docs).items():
        spans = [tuple(s) for s in rows[d]["spans"]]
        assert all(any(a <= i and i + 50 <= b for a, b in spans) for i in starts)
    for d, r in rows.items():
        own, at = windows(docs[d]), defaultdict(list)
        others = {x: windows(docs[x]) for x in r["repeat_of"]}
        for x in others:
            for q in range(len(docs[x]) - 4):
                at[tuple(docs[x][q : q + 5])].append((x, q))
        for a, b in r["spans"]:
            reached = set()
            for i in range(max(0, a - 10), min(len(own), b)):
                tried = {(x, q - k) for k in range(46) for x, q in at[tuple(docs[d][i + k : i + k + 5])]}
                beside = [others[x][j] for x, j in tried if 0 <= j < len(others[x])]
                if any(len(own[i] & w) >= 0.8 * len(own[i] | w) for w in beside):
                    reached |= set(range(i, i + 50))
            assert reached >= set(range(a, b))


def test_planted_passages_with_one_changed_word(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(120)]
    rows = []
    for d in range(40):
        own = list(passage)
        own[60] = word()
        rows.append((d, " ".join([word() for _ in range(200)] + own + [word() for _ in range(150)])))
    rows += [(d, " ".join(word() for _ in range(300))) for d in range(40, 60)]
    got = {r["doc_id"]: r for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(1, 40))
    assert all(r["spans"][0]["start"] <= 201 and r["spans"][-1]["end"] >= 319 for r in got.values())


def test_compact_windows_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in (5, 30, 200):
        values = rng.integers(0, 50, n).tolist()
        left, right = passages.compact_windows(values, list(range(n)))
        for c in range(n):
            lo = max([i for i in range(c) if values[i] <= values[c]], default=-1)
            hi = min([i for i in range(c + 1, n) if values[i] < values[c]], default=n)
            assert (left[c], right[c]) == (lo, hi)


def test_signatures_cover_every_start():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * 3 for _ in range(k)).encode() for k in (0, 3, 49, 50, 51, 200, 700)]
    with np.errstate(over="ignore"):
        at, key, packed = passages.signatures(texts)
        for t, text in enumerate(texts):
            n = len(text.split()) - passages.SHINGLE + 1 - passages.LENGTH + 1
            rows = [(int(p) >> 12, int(p) >> 6 & 63, int(p) & 63) for a, p in zip(at, packed) if a == t]
            covered = [i for c, lo, hi in rows for i in range(c - lo, c - hi + 1)]
            assert sorted(covered) == sorted(len(passages.BANDS) * list(range(max(0, n))))


def test_remove_repeats_keeps_the_first_copy(spark):
    rnd = random.Random(9)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    head, shared, tail = " ".join(words[:60]), " ".join(words[60:160]), " ".join(words[160:230])
    rows = [(1, f"{head}\n{shared}", 5), (2, f"{shared} \n{tail}", 6), (3, shared, 7), (4, f"{tail[:40]} other", 8)]
    got = {r["doc_id"]: r for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["text"] == rows[0][1] and got[2]["text"].split() == tail.split()
    assert got[2]["n_chars"] == len(got[2]["text"])


def test_rows_of_one_id_are_cut_each_by_its_own_repeats(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    shared, other, long = text(80), text(30), text(300)
    rows = [(1, shared), (1, shared), (2, other), (2, f"{long}\n{shared}"), (None, shared)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", shared), ("2", other), ("2", long), ("None", shared)])


def test_long_inputs_are_cut_by_size_and_minima_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << 62, 5000, np.uint64) & ~np.uint64((1 << 24) - 1)
    assert passages.window_minima(values, 46, 200).tolist() == passages.window_minima(values, 46).tolist()
    import pyarrow as pa

    monkeypatch.setattr(passages, "PIECE", 1000)
    texts = ["x" * n for n in (10, 990, 1, 5000, 3)] + ["y"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["uid", "text"])
    parts = [p.num_rows for p in passages._pieces(batch)]
    assert sum(parts) == len(texts) and parts[:4] == [2, 1, 1, 257 - 1] and max(parts) <= passages.SLICE


def test_a_leader_that_repeats_a_frequent_line_hides_nothing(spark):
    rnd = random.Random(12)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    line = words(30)
    rows = []
    for k in range(12):
        before, after, end = words(24), words(24), words(90)
        first = [*words(60), *line, *words(70), *before, *line, *after, *words(50)]
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join([*before, *line, *after, *end]))]
    got = {r["doc_id"]: r["spans"] for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(12):
        assert any(s["start"] == 0 and s["end"] >= 78 for s in got[2 * k + 1])


def test_near_recall_against_brute_force(spark):
    rnd = random.Random(13)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    rows, want = [], set()
    shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    for k in range(300):
        passage = words(rnd.choice((50, 50, 60, 80, 120)))
        near = list(passage)
        for _ in range(rnd.choice((1, 1, 2))):
            near[rnd.randrange(len(near))] = words(1)[0]
        if rnd.random() < 0.3:
            near.insert(rnd.randrange(len(near)), words(1)[0])
        rows += [(2 * k, " ".join([*words(80), *passage, *words(40)])), (2 * k + 1, " ".join([*words(50), *near, *words(70)]))]
        windows = [shingles(passage[i : i + 50]) for i in range(len(passage) - 49)]
        if any(len(a & b) >= 0.8 * len(a | b) for i in range(len(near) - 49) for b in [shingles(near[i : i + 50])] for a in windows):
            want.add(2 * k + 1)
    got = {r["doc_id"] for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 150 and len(got & want) >= 0.9 * len(want)


def test_edges(edge, clash, empty):
    got = passages.repeats(edge)
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert 6 in by and 1 not in by and 7 not in by
    assert passages.remove_repeats(clash).columns == clash.columns
    assert passages.repeats(empty).count() == 0 and passages.remove_repeats(empty).count() == 0


def test_two_short_pieces_are_no_passage(spark):
    """Two pieces of 25 words, adjacent in one text and 300 words apart in the other: no window of 50 words is similar."""
    rnd = random.Random(21)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    rows = []
    for k in range(120):
        one, two = words(25), words(25)
        rows += [(2 * k, " ".join([*words(40), *one, *words(300), *two, *words(40)])), (2 * k + 1, " ".join([*words(60), *one, *two, *words(60)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.repeats(docs).count() == 0
    assert {r["doc_id"]: r["text"] for r in passages.remove_repeats(docs).collect()} == dict(rows)


def test_spans_equal_brute_force_over_windows():
    """similar_spans against all windows of both texts: nothing else is reported; changed, added and missing words, repeats inside."""
    rnd = random.Random(22)
    found = missed = 0
    for k in range(150):
        word = lambda: f"w{rnd.randint(0, 30 if k % 3 == 0 else 10**6)}"
        passage = [word() for _ in range(rnd.choice((50, 60, 90)))]
        other = list(passage)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(other))
            other[at : at + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
        a = [*(word() for _ in range(rnd.randint(0, 40))), *other, *(word() for _ in range(30))]
        b = [*(word() for _ in range(rnd.randint(0, 40))), *passage, *(word() for _ in range(30))]
        with np.errstate(over="ignore"):
            x, y = (passages._shingles(" ".join(t).encode()) for t in (a, b))
        offsets = {i - j for i in range(len(x)) for j in range(len(y)) if x[i] == y[j]}
        spans = passages.similar_spans(x, y, sorted(offsets))
        theirs = windows(b)
        alike = {i for i, w in enumerate(windows(a)) if any(len(w & v) >= 0.8 * len(w | v) for v in theirs)}
        covered = set().union(*(range(lo, hi) for lo, hi in spans))
        assert covered <= set().union(*(range(i, i + 50) for i in alike))
        found, missed = found + bool(alike and spans), missed + bool(alike and not spans)
    assert found > 60 and missed <= 0.02 * found


def test_each_round_has_a_leader_of_its_own(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(d, f"a{d} b{d} {passage} c{d} d{d}") for d in range(1, 7)], "doc_id long, text string")
    leads = []

    def nothing_found(members, texts):
        leads.append({r["lead"] for r in members.select("lead").distinct().collect()})
        return spark.createDataFrame([], "uid long, lead long, start long, end long")

    monkeypatch.setattr(passages, "_near", nothing_found)
    _, spans = passages.repeated_spans(docs)
    assert leads[0] == {1} and leads[1] == {2} and leads[2] == {3}
    # the exact round still sees every text that is open
    assert {(r["uid"], r["lead"]) for r in spans.collect()} == {(d, 1) for d in range(2, 7)}


def test_counted_places_give_the_same_passages_as_sorted_sets():
    """Passages whose shingles occur once are counted by places; the verdict is that of the sets."""
    rng = np.random.default_rng(3)
    seen = {True: 0, False: 0}
    for k in range(60):
        w = rng.integers(0, 60 if k % 3 == 0 else 10**9, int(rng.integers(60, 400))).tolist()
        v = list(w)
        for _ in range(int(rng.integers(1, 12))):
            at = int(rng.integers(0, len(v)))
            v[at : at + int(rng.integers(0, 3))] = rng.integers(0, 10**9, int(rng.integers(0, 3))).tolist()
        a, b = (np.array(passages.shingle_hashes(np.array(x, np.uint64))) for x in (v, w))
        known = passages._Places(a, b, passages.LENGTH)
        for offset in (-3, 0, 1, 40):
            at = np.arange(max(0, offset), max(0, offset, min(len(a), len(b) + offset) - passages.LENGTH + 1))
            at = at[~(known.mixed[0][at] | known.mixed[1][at - offset])]
            got = known.alike(at, offset, passages.SIMILARITY)
            assert (got == passages._alike(a, b, at, offset, passages.LENGTH, passages.SIMILARITY)).all()
            for x in got.tolist():
                seen[x] += 1
    assert min(seen.values()) > 500


def test_no_leader_hides_a_near_passage_around_a_frequent_line(spark):
    """Near passages around a line that 160 texts share: what shares a signature and is similar is found, however many texts come before."""
    rnd = random.Random(31)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    line, rows = words(36), []
    for k in range(80):
        before, after = words(8), words(8)
        near = [*before, *line, *after]
        for at in rnd.sample([*range(1, 7), *range(46, 51)], 1):
            near[at] = words(1)[0]
        rows += [(k, " ".join([*words(20), *before, *line, *after, *words(20)])), (1000 + k, " ".join([*words(30), *near, *words(10)]))]
    with np.errstate(over="ignore"):
        at, key, packed = passages.signatures([t.encode() for _, t in rows])
    held, want = defaultdict(list), set()
    for a, k, p in zip(at.tolist(), key.tolist(), packed.tolist()):
        held[k].append((rows[a][0], p >> 12, p >> 6 & 63, p & 63))
    shingles = {d: windows(t.split()) for d, t in rows}
    for group in held.values():
        for d, c, lo, hi in group:
            for other, c2, lo2, hi2 in group:
                for back in range(max(hi, hi2), min(lo, lo2) + 1) if other < d else ():
                    a, b = shingles[d][c - back], shingles[other][c2 - back]
                    if len(a & b) >= 0.8 * len(a | b):
                        want.add((d, c - back))
    got = {r["doc_id"]: r["spans"] for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({d for d, _ in want}) > 60
    assert all(any(s["start"] <= i + 5 and i + 45 <= s["end"] for s in got.get(d, [])) for d, i in want)


def test_cells_find_the_first_similar_row_of_every_start(monkeypatch):
    """_meet against sets of shingles, in pieces of any size."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    width, n = 2 * passages._REACH + 1, 30
    base = rng.integers(1, 1 << 32, width)
    near = np.array([np.where(rng.random(width) < (0.02, 0.06, 0.2)[k % 3], rng.integers(1, 1 << 32, width), base) for k in range(n)], np.uint32)
    packed = np.array([(100 + k) << 12 | int(rng.integers(20, 46)) << 6 | int(rng.integers(0, 20)) for k in range(n)])
    want = set()
    for u in range(n):
        for back in range(packed[u] & 63, (packed[u] >> 6 & 63) + 1):
            for v in range(u):
                if packed[v] & 63 <= back <= packed[v] >> 6 & 63:
                    a, b = (set(near[x, passages._REACH - back : passages._REACH - back + passages.LENGTH].tolist()) for x in (u, v))
                    if len(a & b) >= passages.SIMILARITY * len(a | b):
                        want.add((u, 100 + u - back, v, u - v))
                        break
    rows = [{"asks": asks, "uid": u, "packed": int(packed[u]), "near": near[u].tobytes()} for u in range(n) for asks in (True, False)]
    kind = pa.list_(pa.struct([("asks", pa.bool_()), ("uid", pa.int64()), ("packed", pa.int64()), ("near", pa.binary())]))
    for pairs, checked in ((32_768, 4096), (50, 7)):
        monkeypatch.setattr(passages, "PAIRS", pairs)
        monkeypatch.setattr(passages, "CHECKED", checked)
        found = [b.to_pylist() for b in passages._meet(iter([pa.RecordBatch.from_arrays([pa.array([rows], kind)], ["rows"])]))]
        assert {(r["uid"], r["start"], r["lead"], r["offset"]) for part in found for r in part} == want
    assert len(want) > 20
