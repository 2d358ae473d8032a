"""Operators on documents against brute force, and the cases that every operator must bear."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import _common, _vector, decontaminate, grouping, line_dedup, near_dedup, quality_classifier, quality_rules, sentencepiece

BASE = "the quick brown fox jumps over the lazy dog and then walks home along the river bank in the late evening sun before it sleeps under a tree"
ODD = [(100, None), (101, ""), (102, "   \n "), (103, "one"), (104, "one"), (104, "one"), (None, "nobody knows this text"), (105, "long " * 30_000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # extra columns, with names that operators use
    return df.withColumns({"lang": F.lit("en"), "n": F.lit(1), "key": F.lit("k"), "id": F.lit(5), "version": F.lit(0), "line": F.lit(0)}) if extra else df


def copies():
    words = BASE.split()
    rows = [(1, BASE), (2, BASE.upper()), (3, BASE + " end"), (4, " ".join(words[::-1]))]
    rows += [(10 + i, " ".join([*(f"w{j}" for j in range(60)), f"tail{i}"])) for i in range(5)]
    rows += [(30 + i, " ".join(f"x{j}" for j in range(i, i + 40))) for i in range(8)]  # a chain
    return rows + ODD


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rows = copies()
    sets = [(i, shingles(t, k)) for i, t in rows]
    of = {i: i for i, _ in rows if i is not None}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            of[max(root(a), root(b))] = min(root(a), root(b))
    got = near_dedup.near_duplicates(frame(spark, rows), near_dedup.MinHash(words=k)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == root(r["doc_id"]) and r["kept"] == (r["doc_id"] == root(r["doc_id"]))
    sizes = {i: len(s) for i, s in sets}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_near_duplicates_of_two_texts_under_one_id(spark):
    x, y = (" ".join(f"{c}{j}" for j in range(50)) for c in "xy")
    rows = [(5, x), (5, y), (7, x + " more"), (8, y + " more"), (3, y + " and"), (9, "far off")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {5: 3, 7: 3, 8: 3, 3: 3, 9: 9}


@pytest.mark.parametrize("few", [grouping.FEW_EDGES, 0])
def test_components_against_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(grouping, "FEW_EDGES", few)
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 12)] + [(100, i) for i in range(90, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    of = {i: i for e in edges if e[0] != e[1] for i in e}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in edges:
        if a != b:
            of[max(root(a), root(b))] = min(root(a), root(b))
    got = grouping.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for i in of} and len(got) == len(of)


@pytest.mark.parametrize(("small", "places"), [(24, 0), (3, 2)])
def test_buckets_and_links_against_all_pairs(spark, monkeypatch, small, places):
    """Numbers linked if they differ by at most 2 stand in crowded buckets with others far off."""
    monkeypatch.setattr(grouping, "CHUNK", 100)
    r = random.Random(9)
    ids = sorted(r.sample(range(4000), 300))
    keys = [(int(k), i) for i in ids for k in grouping.packed_keys(np.array([(1 << 40) * (1 + i % 3), (1 << 40) * 7], np.uint64), np.array([100 + i // 400] * 2))]
    pairs, crowded = grouping.buckets(spark.createDataFrame(keys, "key long, id long").repartition(3), grouping.Reach(3, places), small)
    near = lambda x, y: np.where(np.abs(np.ascontiguousarray(x).view("<i8")[..., 0] - np.ascontiguousarray(y).view("<i8")[..., 0]) <= 40, 1, -1)
    signatures = spark.createDataFrame([(i, bytearray(np.int64(i).tobytes())) for i in ids], "id long, sig binary")
    got = {x["id"]: x["component"] for x in grouping.connect(pairs, crowded, signatures, near, lambda p: p.where("b - a <= 12")).collect()}
    want, last = {}, None
    for i in ids:
        want[i] = want[last] if last is not None and i - last <= 12 else i
        last = i
    sizes = {c: sum(x == c for x in want.values()) for c in want.values()}
    assert got == {i: c for i, c in want.items() if sizes[c] > 1}


def test_only_members_that_held_pairs_back_offer_again(spark, monkeypatch):
    """Of 41 rows of one bucket, 0 to 39 near each other in tens but not linked; 40 is near 39 alone, and linked."""
    met, blocks = [], grouping._blocks
    monkeypatch.setattr(grouping, "_blocks", lambda marked: met.append({r["id"] for r in marked.where("out").collect()}) or blocks(marked))
    value = {i: 1000 * (i // 10) + i % 10 for i in range(40)} | {40: 5000, 41: 5001}
    number = lambda x: np.ascontiguousarray(x).view("<i8")[..., 0]
    near = lambda x, y: np.where(np.abs(number(x) - number(y)) < 100, 1, -1)
    crowded = spark.createDataFrame([(7, i) for i in value], "key long, id long")
    signatures = spark.createDataFrame([(i, bytearray(np.int64(v).tobytes())) for i, v in value.items()], "id long, sig binary")
    pairs = spark.createDataFrame([(0, 1, 1)], "a long, b long, n long")
    got = grouping.connect(pairs, crowded, signatures, near, lambda p: p.where("(a = 40 and b = 41) or (a = 8 and b = 9)")).collect()
    assert {r["id"]: r["component"] for r in got} == {40: 40, 41: 40, 8: 8, 9: 8}
    assert len(met) == 3 and not {40, 41} & (met[1] | met[2]) and met[1] and not met[2] - met[1]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_members_with_several_buckets_in_common_meet_in_the_first(spark, monkeypatch, seed):
    """Rows 0 to 39 stand in buckets 1 to 5, row 40 in the third alone, or all in random ones; links are those of all pairs that share one."""
    monkeypatch.setattr(grouping, "CHUNK", 16)
    met, blocks = [], grouping._blocks
    monkeypatch.setattr(grouping, "_blocks", lambda marked: met.append(marked.where("out").count()) or blocks(marked))
    r = random.Random(seed)
    keys = {i: [1, 2, 3, 4, 5] for i in range(40)} | {40: [3]} if seed is None else {i: sorted(r.sample(range(12), r.randint(1, 8))) for i in range(41)}
    joins = {(7, 40)} if seed is None else {(i, j) for i in keys for j in keys if i < j and set(keys[i]) & set(keys[j]) and r.random() < 0.03}
    narrow = spark.createDataFrame([(k, i, len(of) - n) for i, of in keys.items() for n, k in enumerate(of)], "key long, id long, rest long")
    crowded = spark.createDataFrame([(7, i) for i in keys], "key long, id long")
    signatures = spark.createDataFrame([(i, bytearray(8)) for i in keys], "id long, sig binary")
    linked = spark.createDataFrame(sorted(joins), "a long, b long")
    near = lambda x, y: np.ones(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
    fits = lambda x, y: np.ones((len(x), len(y)), bool)
    found = grouping.connect(spark.createDataFrame([], "a long, b long, n long"), crowded, signatures, near, lambda p: p.join(linked, ["a", "b"], "left_semi"), "", lambda ids: narrow, fits)
    of = {i: i for i in keys}
    for i, j in sorted(joins) * 41:
        of[i] = of[j] = min(of[i], of[j])
    got = {x["id"]: x["component"] for x in found.collect()}
    assert got == {i: c for i, c in of.items() if any(i in x for x in joins)}
    assert seed is not None or met[0] <= 41


def test_shingles_of_every_piece_of_a_batch():
    texts = [f"Ab {i} Çd AB {i}\n" * (i % 9) + " Éf" for i in range(500)] + [None, "", " "]
    for valid in (True, False):
        batch = pa.RecordBatch.from_arrays([pa.array(texts if valid else [t or "" for t in texts], pa.string())], ["text"])
        parts = list(_vector.pieces(batch, "text", 3_000))
        assert len(parts) > 3
        got = [g for part in parts for g in _vector.shingles(*_vector.word_hashes(part.column("text")), 2)]
        alone = [g for t in texts for g in _vector.shingles(*_vector.word_hashes(pa.array([t], pa.string())), 2)]
        assert [len(g) for g in got] == [len(shingles(t, 2)) for t in texts]
        assert all(np.array_equal(x, y) for x, y in zip(got, alone, strict=True))


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, []), near_dedup.MinHash()).isEmpty()


def brute_report(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for _, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination(spark):
    item = " ".join(f"Q{c}" for c in "abcdefghijklmnopqrs")
    items = [(1, item), (2, "tiny item"), (3, None), (4, "!!"), (5, " ".join(item.split()[3:17])), (6, "a a a a a a a a a a a a a a")]
    rows = [(1, f"before, {item.upper()} after"), (2, " ".join(item.split()[:12])), (3, "a TINY-item here"), (4, "a " * 30), (5, BASE), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.report(frame(spark, rows), bench).collect()
    want = brute_report(rows, items)
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == sorted((repr(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert decontaminate.report(frame(spark, rows), bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.report(frame(spark, []), bench).isEmpty()
    kept = decontaminate.remove_contaminated(frame(spark, rows), bench)
    assert 1 not in {r["doc_id"] for r in kept.collect()} and kept.columns == frame(spark, rows).columns
    index = decontaminate.build_index(frame(spark, rows), decontaminate.item_terms(bench))
    near = decontaminate.proximity_matches(index, decontaminate.item_terms(bench.where("item_id = 2")), 3)
    assert near.count() == 1


def test_lines(spark):
    long = "this is a line of many words that stands in several documents of the corpus"
    rows = [(1, f"{long}\nalone here\n---"), (2, f"{long.upper()}!\nown text of two"), (3, f"{long} x\nthird"), (4, "alone here\n\n---"), *ODD]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1] == rows[0][1] and text[2] == "own text of two" and text[4] == "\n---" and text[100] is None and text[101] == ""
    assert len(got) == len(rows) and {r["n_lines"] for r in got if r["doc_id"] == 100} == {0}
    assert [r["text"] for r in got if r["doc_id"] == 104] == [rows[8][1].replace("one", "")] * 2 or len({r["text"] for r in got if r["doc_id"] == 104}) == 1
    assert line_dedup.dedup_lines(frame(spark, [])).isEmpty()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited_lines():
    """(words, line, edited line): one word in about 20 replaced, added, left out or misspelt, or a letter in 14 changed."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    for n in (1, 2, 3, 4, 5, 8, 12, 20, 30, 60, 120):
        for kind in ("replaced", "added", "gone", "misspelt", "letters"):
            for _ in range(4):
                words = [word() for _ in range(n)]
                new = list(words)
                for at in r.sample(range(n), max(1, n // 20)):
                    w = new[at]
                    new[at] = {"replaced": word(), "added": w + " " + word(), "gone": "", "misspelt": w[:-1] + r.choice("xyz") + w[-1], "letters": w}[kind]
                new = " ".join(w for w in new if w)
                if kind == "letters":
                    new = "".join(r.choice("qwz") if c != " " and r.random() < 0.07 else c for c in new)
                if new and new != " ".join(words):
                    yield n, " ".join(words), new


def test_lines_against_brute_force(spark):
    cases = list(edited_lines())
    docs = frame(spark, [x for i, (_, a, b) in enumerate(cases) for x in ((2 * i, a), (2 * i + 1, b))])
    removed = {r["doc_id"] for r in line_dedup.repeated_lines(docs).collect()}
    linked = [10 * edit_distance(a, b) <= max(len(a), len(b)) for _, a, b in cases]
    classes = [(0, 5), (5, 20), (20, 50), (50, 1000)]
    assert all(sum(x for (n, _, _), x in zip(cases, linked, strict=True) if low <= n < high) >= 10 for low, high in classes)
    assert removed == {2 * i + 1 for i, x in enumerate(linked) if x}


def crowded_lines():
    """Lines of 160 characters and more: a family of 40 in two halves, and 40 others, all with one common passage."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8)))
    passage, base = " ".join(word() for _ in range(12)), [word() for _ in range(20)]
    other = [*base[:-9], *(word() for _ in range(9))]
    change = lambda words: " ".join(word() if k == at else w for at in [r.randrange(len(words))] for k, w in enumerate(words))
    return [f"{passage} {change(base if i % 2 else other)}" for i in range(40)] + [f"{passage} {' '.join(word() for _ in range(20))}" for _ in range(40)]


@pytest.mark.parametrize("part", [grouping.PART, 20])
def test_crowded_lines_against_brute_force(spark, monkeypatch, part):
    """However large, a bucket is gone through once, and of the tables on the way none stays."""
    monkeypatch.setattr(grouping, "PART", part)
    names, put = [], grouping.store
    monkeypatch.setattr(grouping, "store", lambda df, name, owner="": names.append(name) or put(df, name, owner))
    before = {k: len(v) for k, v in _common._stored.items()}
    lines = crowded_lines()
    removed = {r["doc_id"] for r in line_dedup.repeated_lines(frame(spark, list(enumerate(lines)))).collect()}
    group = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if group[i] != group[j] and line_dedup.distance(a, b, len(a) + len(b)) <= line_dedup.edits(max(len(a), len(b)), 0.9):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert removed == {i for i, g in enumerate(group) if i != g} and 20 <= len(removed) <= 39
    assert names.count("links") <= 3 + grouping.SLICES
    assert sum(len(v) for v in _common._stored.values()) == sum(before.values()) + 1


def test_lines_with_one_passage_are_not_crowded(spark, monkeypatch):
    """Lines that share a passage alone stand in no crowded bucket, and in no more pairs than lines."""
    seen, link = [], line_dedup.connect_texts
    monkeypatch.setattr(line_dedup, "connect_texts", lambda pairs, crowded, *rest: seen.append((pairs.count(), crowded.count())) or link(pairs, crowded, *rest))
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8)))
    passage = " ".join(word() for _ in range(6))
    lines = [f"{passage} {' '.join(word() for _ in range(11))}" for _ in range(120)]
    assert line_dedup.repeated_lines(frame(spark, list(enumerate(lines)))).isEmpty()
    assert seen[0][0] <= len(lines) and seen[0][1] == 0


def test_only_lines_alike_with_another_component_bring_their_texts(spark, monkeypatch):
    """Of a bucket with a family of 16 linked lines and two others of the same letters in another order, the two alone."""
    seen, put = [], grouping.store
    monkeypatch.setattr(grouping, "store", lambda df, name, owner="": [t := put(df, name, owner), seen.append({r["id"] for r in t.select("id").collect()}) if name == "signed" else None][0])
    r = random.Random(8)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(3, 8)))
    passage, base, other = (" ".join(word(letters) for _ in range(n)) for letters, n in (("abcdefghi", 16), ("abcdefgh", 8), ("mnop", 8)))
    lines = [f"{passage} {base} {chr(97 + i)}" for i in range(16)] + [f"{passage} {other}", f"{passage} {other[::-1]}"]
    assert {x["doc_id"] for x in line_dedup.repeated_lines(frame(spark, list(enumerate(lines)))).collect()} == set(range(1, 16))
    assert [len(ids) for ids in seen] == [2]


def test_packed_entries_are_the_sorted_distinct_ones(monkeypatch):
    monkeypatch.setattr(grouping, "PACK", 300)
    r = np.random.default_rng(3)
    k, i = r.integers(-(2**63), 2**63 - 1, 200)[r.integers(0, 200, 2000)], r.integers(0, 5, 2000)
    batches = pa.table({"key": k, "id": i, "sketch": k ^ i}).to_batches(max_chunksize=170)
    packed = [x for b in grouping._packed(lambda b: b)(batches) for x in b.to_pylist()]
    assert len(packed) < 1500 and all(-2048 <= x["range"] < 2048 for x in packed)
    packed.sort(key=lambda x: x["range"])
    rows = pa.RecordBatch.from_pylist(packed, pa.schema([("range", pa.int32()), ("rows", pa.binary())]))
    got = [tuple(x.values()) for b in grouping._unpacked(rows.slice(a, 7) for a in range(0, len(rows), 7)) for x in b.to_pylist()]
    assert got == sorted({(a, b, a ^ b) for a, b in zip(k.tolist(), i.tolist(), strict=True)})


@pytest.mark.parametrize("part", [grouping.PART, 20])
def test_scan_offers_every_pair_that_is_alike(monkeypatch, part):
    """As a pair or as members of one crowded bucket, in batches that cut buckets; and sketches admit all linked lines."""
    monkeypatch.setattr(grouping, "PART", part)
    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefgh uvw\u0434", k=n))
    lines = []
    for n in [5, 30, 59, 60, 100, 300] * 2:
        lines += [x := text(n), *("".join(text(1) if k in at else c for k, c in enumerate(x)) for at in (r.sample(range(n), r.randint(0, n // 7)) for _ in range(r.choice([1, 6, 15]))))]
    alike, reach = line_dedup.alike(0.9), grouping.Reach.of(0.9, 8)
    bucket = np.array([r.choice([3, 4, 5, 5, 5, 9 + i // 6]) for i in range(len(lines))], np.uint64) << np.uint64(40)
    key, sketch, ids = grouping.packed_keys(bucket, np.array([len(x) for x in lines])), line_dedup.sketches(lines), np.arange(len(lines))
    order = np.lexsort((ids, key))
    rows = pa.table({"key": key[order], "id": ids[order], "sketch": sketch[order]}).to_batches(max_chunksize=70)
    pairs, crowds = set(), set()
    for t in (b.to_pylist() for b in grouping._scan(reach, 4, alike)(rows)):
        pairs |= {(x["a"], x["b"]) for x in t if x["key"] is None}
        crowds |= {(x["key"] >> grouping.LOW_BITS, x["b"]) for x in t if x["key"] is not None}
    for i in range(len(lines)):
        for j in range(i):
            k, at, of = bucket[i] >> np.uint64(grouping.LOW_BITS), slice(i, i + 1), slice(j, j + 1)
            admitted = reach.test(key[at], key[of])[0] and alike(key[at], key[of], sketch[at], sketch[of])[0]
            if bucket[i] == bucket[j] and admitted:
                assert (j, i) in pairs or {(int(k), i), (int(k), j)} <= crowds
            assert admitted or line_dedup.distance(lines[i], lines[j], 400) > line_dedup.edits(max(len(lines[i]), len(lines[j])), 0.9)
    assert pairs and crowds


def test_normal_lines_of_all_letters():
    r = random.Random(3)
    lines = ["".join(r.choices("aZ09 ,.-ÀÉéß×÷ñ–“x中文İ\t_", k=r.randint(0, 12))) for _ in range(3000)] + ["", "  ", "É É", "--"]
    assert line_dedup.normal(pa.array(lines)).to_pylist() == line_dedup._exactly_normal(pa.array(lines)).to_pylist()


def test_within_against_edit_distance():
    r = random.Random(1)
    for _ in range(2000):
        a = "".join(r.choices("abcé", k=r.randint(0, 30)))
        b = "".join(r.choices("abcé", k=r.randint(0, 30))) if r.random() < 0.4 else "".join(c for c in a if r.random() > 0.1) + r.choice(["", "a", "xy"])
        most = r.randint(0, 12)
        assert line_dedup.within(a, b, most) == (edit_distance(a, b) <= most)


@pytest.mark.parametrize("few", [line_dedup.FEW, 1])
def test_many_pairs_at_once_against_edit_distance(monkeypatch, few):
    """Hundreds of pairs with bands of one word and of several, of which the batch leaves few to be compared alone."""
    alone, one = [], line_dedup.within
    monkeypatch.setattr(line_dedup, "within", lambda *pair: alone.append(pair) or one(*pair))
    monkeypatch.setattr(line_dedup, "FEW", few)
    r = random.Random(11)
    cases = [("", "", 0), ("", "ab", 2), ("", "ab", 1), ("a", "b", 0), ("a", "b", 1)]
    for n in [r.randint(2, 60) for _ in range(300)] + [r.randint(60, 160) for _ in range(60)] + [r.randint(200, 400) for _ in range(40)]:
        a = "".join(r.choices("abc \u00e9\u4e2d\U0001f600", k=n))
        b = list(a)
        for _ in range(r.randint(0, max(1, n // 6))):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "x", "\u00e9"])
        cases.append((*r.sample([a, "".join(b)], 2), r.choice([n // 10, n // 8, n // 5, n // 2, n])))
    assert line_dedup.within_all([], [], []).tolist() == []
    assert line_dedup.within_all(*map(list, zip(*cases, strict=True))).tolist() == [edit_distance(a, b) <= most for a, b, most in cases]
    assert len({(most + 63) // 64 for _, _, most in cases}) >= 5 and len(alone) <= (150 if few > 1 else 0)


def test_lines_are_cut_of_any_column(spark):
    """Names are kept, other columns too, and lines count that have letters or digits beyond ASCII alone."""
    long = "this is a line of many words that stands in several documents of the corpus"
    rows = [(1, f"{long}\n\u00bf?\n\u4e2d\u6587\n\n---\u2014", [1, 2]), (2, f"\n{long}\n", None), (3, None, []), (4, "", [3]), (5, long, [4])]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, other array<int>").withColumn("N_LINES", F.lit("x"))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "Text", "other", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, rows[0][1], [1, 2], 2, 0), (2, "\n", None, 1, 1), (3, None, [], 0, 0), (4, "", [3], 0, 0), (5, "", [4], 1, 1)]
    assert [len(line_dedup._worded(pa.array(x, pa.large_string()))) for x in ([], [""], ["", "a"])] == [0, 1, 2]


def test_quality_rules(spark):
    good = [(10_000 + i, " ".join(f"g{i}w{j}" for j in range(60))) for i in range(900)]  # fewer could certify nothing at this level
    junk = [(3000 + i, " ".join(f"J{i}W{j}###" for j in range(60))) for i in range(100)]
    rows = good + junk + [(2000, "a b c " * 40)] + ODD
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(None, 1), (5, None)], "doc_id long, quality int")
    table = {(r["doc_id"]): r for r in quality_rules.quality_table(frame(spark, rows), labels).collect()}
    p = quality_rules.P
    assert all(table[i][f"{p}kept"] for i, _ in good[:50]) and not table[3000][f"{p}kept"] and not table[2000][f"{p}kept"]
    assert table[2000][f"{p}n_repeat_words"] == 120 and table[3000][f"{p}n_symbols"] == 180 and table[100][f"{p}n_words"] == 0
    kept = quality_rules.quality_filter(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in table.items() if r[f"{p}kept"]}
    assert quality_rules.quality_table(frame(spark, rows), labels.limit(0)).count() == len(rows)
    assert quality_rules.quality_table(frame(spark, []), labels).isEmpty()


def test_classifier(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(40))) for i in range(300)] + [(1000 + i, " ".join(f"WORD{(i + j) % 50}!!" for j in range(40))) for i in range(150)] + ODD
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i is not None and not 100 <= i <= 105] + [(None, 1)], "doc_id long, quality int")
    s = quality_classifier.Settings(ids=1 << 10, epochs=20)
    got = quality_classifier.score(frame(spark, rows), labels, s).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and not 100 <= r["doc_id"] <= 105]
    assert len(held) > 20 and all(r["predicted"] == int(r["doc_id"] < 1000) for r in held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_classifier.score(frame(spark, rows[:3]), labels.limit(0), s).collect()} == {0.5}
    assert quality_classifier.score(frame(spark, []), labels, s).isEmpty()


def test_sentencepiece(spark):
    model = sentencepiece.Model.load()
    texts = ["Hello world", " lead", "  two  ", "\n\tx", "▁mark", "日本 ü\U0001f600", "", "a" * 500, BASE]

    def best(text):
        """Scores of all segmentations by plain dynamic programming over the pieces."""
        data = (" " + text).replace(" ", "▁")
        scores = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k in (1, 4)}
        top = [0.0] + [float("-inf")] * len(data)
        for i in range(len(data)):
            for j in range(i + 1, min(len(data), i + 20) + 1):
                if data[i:j] in scores:
                    top[j] = max(top[j], top[i] + scores[data[i:j]])
            if data[i] not in scores:
                top[i + 1] = max(top[i + 1], top[i] + model.unknown_score)
        return top[-1]

    for t in texts:
        ids = model.encode(t)
        assert model.decode(ids) == t
        if t and "▁" not in t and t.isascii() and "\t" not in t:
            assert abs(sum(model.scores[i] if model.kinds[i] != 6 else model.unknown_score for i in ids) - best(t)) < 1e-6
    rows = list(enumerate(texts)) + ODD
    got = sentencepiece.encode(frame(spark, rows).withColumn("n_tokens", F.lit("old")), model)
    assert got.where("not round_trip").isEmpty() and got.count() == len(rows)
    back = sentencepiece.decode(got, model)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back.collect()))) == sorted(map(repr, rows))
    assert hashlib.sha256(str(got.where("doc_id = 0").first()["token_ids"]).encode()).hexdigest()
