"""WARC archives, token shards, page text and chat windows."""

import hashlib
import re
import threading
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loomgraph.llm import _common, chat_format, html_extract, token_output, warc


def test_warc(spark, tmp_path):
    big = "<p>" + "payload é " * 200
    rows = [(1, "http://a/\r\nx: y", big), (7, "http://b", big), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "n", big), (9, "", "x" * 300_000), (2, "q", ""), (2, "q", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("?"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, warc.Archive(size=2000, sample=100))
    got = warc.read_archives(spark, path, payloads=True)
    assert sorted(map(repr, ((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got.collect()))) == sorted(map(repr, ((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)))
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got.collect()}
    assert kinds[7] == ("response", None) and kinds[1] == kinds[None] == ("revisit", 7) and kinds[3][0] == kinds[4][0] == "response"
    assert {r["payload"].decode() for r in warc.resolve_revisits(got).where("page_id = 1").collect()} == {big}
    empty = f"file://{tmp_path}/e"
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).isEmpty()


@pytest.mark.parametrize("url", ["http://a/b%20c?d=%0A", "http://ä.example/ü", "http://a/b c", " http://a\r\nb%41", "", None])
def test_warc_keeps_urls(url):
    record = warc.make_record(1, url, b"x", warc.sha1_label(b"x"), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["url"] == url


def test_warc_faults():
    record = warc.make_record(1, "http://a", b"hello", warc.sha1_label(b"hello"), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"hello"
    for broken in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"hello", b"hellO"), record.replace(b"WARC-Date", b"Other")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(broken)
    writer = warc.Writer(warc.Archive(sample=20_000))
    archive = b"".join(a for i in range(200) for a in writer.add(record.replace(b"hello", b"hell%d" % (i % 10)))) + b"".join(writer.finish())
    assert archive[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and len(list(warc.frames(archive))) == 200
    for broken in (archive[:-3], archive + b"12345678", archive[:200]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(broken))
    raw = b"a raw dictionary of words " * 20
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert list(warc.frames(warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + c.compress(record))) == [record]


def test_token_shards(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "a b c", "a b c"] + ["word%d other thing. " % (i % 7) * (i * 3) for i in range(40)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(3)
    lay = token_output.Layout(length=16, per_shard=10, per_task=2, per_run=4)
    path = f"file://{tmp_path}/s"
    n = token_output.materialise(df, path, lay)
    r = token_output.read_slots(spark, path, lay).toPandas().sort_values("sequence")
    assert sorted(r.slot) == sorted(r.sequence) == list(range(n))
    tokens, docs, now = token_output.Tokens(), Counter(), []
    for x in np.concatenate([np.array(x) for x in r.token_ids]):
        if x == tokens.end:
            docs[tuple(now)] += 1
            now = []
        else:
            now.append(int(x))
    assert docs == Counter(tuple(np.frombuffer(tokens(t), "<u2").tolist()) for _, t in rows if t) and not now
    part = token_output.read_slots(spark, path, lay, first=13, count=9).toPandas().sort_values("slot")
    assert list(part.slot) == list(range(13, 22)) and part.token_ids.map(list).tolist() == r.sort_values("slot").token_ids.map(list).tolist()[13:22]
    with pytest.raises(Exception, match="header"):
        token_output.read_slots(spark, path, token_output.Layout(length=16, per_shard=10, key=1)).collect()
    assert token_output.materialise(df.limit(0), f"file://{tmp_path}/t", lay) == 0


def test_token_shards_are_shuffled_in_parts(spark, tmp_path, monkeypatch):
    """Half of the shards at a time, with the slots that all at once would have."""
    parts, write = [], token_output._binary.write_files
    monkeypatch.setattr(token_output._binary, "write_files", lambda df, *a, **k: parts.append({r["shard"] for r in df.select("shard").collect()}) or write(df, *a, **k))
    df = spark.createDataFrame([(i, f"text {i} is of its own. " * (i % 5)) for i in range(60)], "doc_id long, text string").repartition(3).cache()
    lay = token_output.Layout(length=8, per_shard=6, per_task=2, per_run=4)
    rows = []
    for slices in (token_output.SLICES, 1):
        monkeypatch.setattr(token_output, "SLICES", slices)
        path = f"file://{tmp_path}/{slices}"
        n = token_output.materialise(df, path, lay)
        rows.append(sorted(map(tuple, token_output.read_slots(spark, path, lay, packed=True).select("slot", "sequence", "shard", "n_tokens", "token_ids").collect())))
    assert len(parts) == 3 and len(rows[0]) == n > 60 and rows[0] == rows[1]
    assert not parts[0] & parts[1] and parts[0] | parts[1] == parts[2] and 2 * max(map(len, parts[:2])) <= len(parts[2]) + 2 * lay.per_task


def test_shuffles_of_plans_that_are_let_go_late_are_freed(spark):
    """A plan that its listeners hold for a moment after its end, as here a timer does."""
    left = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    _common.free_shuffles(spark)
    before, held = left.size(), [spark.range(100).repartition(3, "id").groupBy("id").count()]
    assert len(held[0].collect()) == 100 and left.size() > before
    timer = threading.Timer(0.25, held.clear)
    timer.start()
    _common.free_shuffles(spark)
    timer.join()
    assert left.size() <= before


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    p = token_output.Permutation(n, 42)
    slots = p.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (p.number(slots) == np.arange(n)).all()


def test_tokens_are_those_of_the_whole_text():
    import public_tokenizers
    import tiktoken

    tokens = token_output.Tokens()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.path, "rb"))}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ["  a  b\n\n c", "x'll don't  ", "\t\n", " ", "1 2  3", "a b  c", "word " * 50 + "日本\n"]:
        assert np.frombuffer(tokens(t), "<u2").tolist() == whole.encode_ordinary(t)


PAGE = """<!DOCTYPE html><html><head><title>no</title></head><body class=has-sidebar><header><h1>Site</h1></header><div id="main-nav" class=menu><a>m</a></div>
<main><article><header><h1>T &amp; U</h1><span>by X</span></header><p>One two<script>var t="</article>";</script> three<p>four &lt;x&gt;&nbsp;y <b>bold<br>line</b>
<div class=ad-slot>buy</div><aside>side</aside><ul><li>l1<li>l2</ul><section id=comments><p>hi</section></article><div class=related>rel</div></main><footer>f</footer>"""


def test_pages(spark):
    notice = "Please accept the rules of this place before you go on reading anything here at all today"
    story = lambda i: f"<html><body><div>{notice}</div><div>Story number {i} " + " ".join(f"s{i}x{j}" for j in range(20)) + f"</div><div><a href=x>Home</a></div><div>{notice} too</div></body></html>"
    rows = [(1, "http://z/1", PAGE), (2, None, None), (3, "x", ""), *((10 + i, f"http://h{i % 2}.com/{i}", story(i)) for i in range(6)), (20, "http://h0.com/c", story(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    for s in (html_extract.Settings(), html_extract.Settings(slice=30)):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, s).collect()}
        assert got[1] == "T & U One two three four <x> y bold line l1 l2" and got[2] == got[3] == ""
        assert all(got[10 + i] == f"Story number {i} " + " ".join(f"s{i}x{j}" for j in range(20)) for i in range(6)) and got[20] == got[10]
    assert html_extract.extract(df.limit(0)).isEmpty()


def brute_text(page, others, least=8):
    """What stays of a page's blocks (links alone, text) by plain search in the other pages."""
    stream = lambda p: [w for _, b in p for w in (None, *b.split())]
    own, seen = stream(page), [stream(p) for p in others]
    parts = {tuple(t[i : i + least]) for t in seen for i in range(len(t) - least + 1)}
    covered = {i + j for i in range(len(own) - least + 1) if tuple(own[i : i + least]) in parts for j in range(least)}
    out, at = [], 0
    for links, b in page:
        words = b.split()
        spots, at = range(at + 1, at + 1 + len(words)), at + 1 + len(words)
        if links and len(words) < least and any((links, b) in p for p in others):
            continue
        mostly = 2 * sum(i in covered for i in spots) > len(words)
        out += [w for i, w in zip(spots, words, strict=True) if not mostly or i not in covered]
    return " ".join(out)


def test_unmarked_pages_against_brute_force(spark):
    r = np.random.default_rng(4)
    shared = [" ".join(f"c{i}n{j}" for j in range(n)) for i, n in enumerate((5, 9, 12, 20, 30))]
    own = lambda n: " ".join(f"w{r.integers(10**6)}" for _ in range(n))
    pages = [[(False, shared[3] + " " + own(6)), (True, "Home"), (True, own(4)), (False, own(15)), (True, own(12))]]
    for _ in range(14):
        pages.append([])
        for _ in range(8):
            some = str(r.choice(shared))
            text = (own(3) + " " + some, some + " " + own(int(r.integers(1, 9))), own(int(r.integers(1, 30))), some, "Home")[r.integers(5)]
            pages[-1].append((bool(r.integers(2)) or text == "Home", text))
    html = ["".join(f"<div><a href=x>{b}</a></div>" if links else f"<div>{b}</div>" for links, b in p) for p in pages]
    df = spark.createDataFrame([(i, "http://h/" + str(i), x) for i, x in enumerate(html)], "page_id long, url string, html string")
    want = {i: brute_text(p, [q for q in pages if q is not p]) for i, p in enumerate(pages)}
    assert len(want[0].split()) == 6 + 4 + 15 + 12
    for s in (html_extract.Settings(), html_extract.Settings(slice=100)):
        assert {x["page_id"]: x["text"] for x in html_extract.extract(df, s).collect()} == want


def test_suffix_ranks_find_repeated_substrings():
    r = np.random.default_rng(1)
    flat = r.integers(0, 3, 400).astype(np.uint64)
    for least in (1, 3, 5, 8):
        rank, seen = html_extract.suffix_ranks(flat, least), {}
        for i in range(len(flat)):
            if i + least > len(flat):
                assert rank[i] == -1
            else:
                assert seen.setdefault(tuple(flat[i : i + least]), rank[i]) == rank[i]
        assert len(set(seen.values())) == len(seen) and [seen[k] for k in sorted(seen)] == sorted(seen.values())


def test_chat(spark):
    rows = [(1, 0, "system", "be <|im_end|> good"), *((1, t, ("user", "assistant")[t % 2 == 0], f"turn {t} " + "word " * (t * 9)) for t in range(1, 30)), (2, 5, "user", None), (2, 5, None, "x"), (3, None, "assistant", "<\\|im_start|>"), (None, 1, "user", "u"), (4, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(0))
    shown = chat_format.windows(turns, chat_format.Budget(200, 50))
    got = {r["conv_id"]: r for r in chat_format.digests(shown).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert shown.where("conv_id = 1").count() > 1
    assert chat_format.digests(chat_format.windows(turns.limit(0))).isEmpty()


@pytest.mark.parametrize("system", [0, 1])
@pytest.mark.parametrize("size", [720, 900, 1010, 3000])
@pytest.mark.parametrize("spot", [0, 20])
def test_a_long_turn_affects_its_window_only(spark, system, size, spot):
    """One long question among 40 short turns: no other window is cut shorter, and answers have their questions."""
    says = [("user", "assistant")[t % 2] + f" says {t} " + "word " * (size - 20 if t == spot else 37) for t in range(40)]
    rows = [(1, -1, "system", "be good")] * system + [(1, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(says)]
    got = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    tokens = lambda x: len(re.findall(r"\w+|[^\w\s]", x))
    assert len(got) <= 6 and sum(r["n_turns"] - r["n_repeated"] for r in got) == 40 + system
    for r in got:
        assert tokens(r["text"]) <= 1024 or says[spot] in r["text"] and r["n_turns"] <= 1 + system
        for t in (int(x) for start, n in r["loss_spans"] for x in re.findall(r"assistant says (\d+)", r["text"][start : start + n])):
            assert says[t - 1] in r["text"] or t - 1 == spot and size > 950
    assert sorted(int(x) for r in got for start, n in r["loss_spans"] for x in re.findall(r"says (\d+)", r["text"][start : start + n])) == list(range(1, 40, 2))
