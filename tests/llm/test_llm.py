"""Each operator against a brute-force version, and on odd input."""

import base64
import collections
import glob
import gzip
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphlens.llm import bpe, exact_dedup, langid, ngram_join, packing, pu_quality, quality_rules, reshard, url_filter, warc
from graphlens.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups".split()) + str(rnd.randrange(30)) for _ in range(n))


def corpus():
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "one", "one two three", "a  b\tc", "a b c", "x|y ### !!\nx|y ### !!\n", "<|endoftext|> über naïve\u3000日本", "word " * 300]
    for _ in range(12):
        base = words(rnd, rnd.randrange(20, 90))
        texts += [base, base, base.upper(), base + " tail", " ".join(base.split()[3:]), words(rnd, 5) + " " + base]
    texts.append(words(rnd, 6000))
    rows = [(k, t, ("en", "fr", None)[k % 3], f"src{k % 4}", len(t or ""), "clash", 1) for k, t in enumerate(texts)]
    rows.append((None, "no id", "en", "s", 5, "clash", 1))
    rows.append((3, "one", "en", "s", 3, "clash", 1))  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    path = shared_dir(spark)
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs, empty):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    got = exact_dedup.exact_duplicates(docs, capacity=2).collect()
    want = sorted((str(r[0]), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows for g in [groups[norm(r[1])]])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_stage_with_null_and_repeated_ids(spark):
    rows = [(1, "a b"), (2, "a  b"), (2, "other"), (None, "a b"), (None, "alone"), (None, "x y"), (None, "x  y"), (5, "same"), (5, "same"), (6, "same"), (7, None), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, re.sub(" +", " ", r.text or "")) for r in corpus_pipeline.exact(spark, df, "").collect())
    assert got == collections.Counter([(1, "a b"), (2, "other"), (None, "alone"), (None, "x y"), (5, "same"), (7, "")])
    assert corpus_pipeline.exact(spark, df.limit(0), "").count() == 0


def test_directory_doubles_and_chains(spark):
    rnd = random.Random(4)
    keys = [rnd.getrandbits(64) - (1 << 63) for _ in range(300)] + list(range(40)) + [7] * 30  # many near 0 share all leading bits
    index = spark.createDataFrame([(k,) for k in keys], "key long")
    directory, bits = exact_dedup.double_directory(index, 8, 3)
    own = {r.pointer: (r.bucket, r.depth) for r in directory.collect()}
    assert bits == 60
    inside = collections.Counter()
    pointers = [(k % (1 << 64)) >> 64 - bits for k in keys]
    for p in pointers:
        bucket, depth = own[p]
        assert bucket == p >> bits - depth << bits - depth
        inside[bucket, depth] += 1
    for (bucket, depth), n in inside.items():
        assert n <= 8 or depth == bits
        if depth:  # the bucket above was overfull
            assert sum(p >> bits - depth + 1 == bucket >> bits - depth + 1 for p in pointers) > 8
    batch = exact_dedup.pa.RecordBatch.from_pydict({"key": [1, 1, 1, 2], "text": [b"a", b"b", b"a", b"a"], "head": [5, 6, 2, 9], "copies": [1, 1, 3, 1]})
    owned = [r for b in exact_dedup._own(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["head"], r["copies"], r["chain"]) for r in owned] == [(1, 2, 4, 2), (1, 6, 1, 2), (2, 9, 1, 1)]


def test_quality_counts_and_rules(spark, docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs, [(quality_rules.Condition("pipe_share", True, 0.1),)]).collect()}
    for doc_id, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        win = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality_rules.judge(empty, []).count() == 0
    rows = spark.createDataFrame([(k, k % 3 == 0, *([50.0] + [0.5 if k % 3 == 0 else 0.01 * (k % 2)] + [0.0] * 7)) for k in range(300)], "doc_id long, bad boolean, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    rules = quality_rules.learn_rules(rows)
    assert rules and all(c.feature == "symbol_share" and c.above for c in rules[0])
    assert quality_rules.learn_rules(rows.where("NOT bad")) == []


def test_urls(spark):
    rows = [("http://WWW.a.org/x?q", "www.a.org", "/x", "org/", "allow"), ("http://org", "org", "", None, None), ("https://m.b.com/de/1#z", "m.b.com", "/de/1", "com/de/", "block"), ("x://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("nothing", "", "", None, None), (None, "", "", None, None)]
    pages = spark.createDataFrame([(k, r[0], "c") for k, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(rows):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_names_of_hosts(spark):
    want = {
        "a.b.example.co.uk": ("co.uk", "example.co.uk"), "example.com": ("com", "example.com"), "u:p@www.example.com:8080": ("com", "example.com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"),
        "[::1]:80": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "x.org.": ("org", "x.org"), "": ("", ""), "co.uk": ("co.uk", "co.uk"),
    }
    name = url_filter.host_name(F.col("host"))
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", *(c.alias(n) for c, n in zip(url_filter.suffix_and_domain(name), "sd", strict=True))).collect()
    assert {r.host: (r.s, r.d) for r in got} == want


def test_reputation_blocks_a_bad_host(spark):
    """A host that most labelled pages of are bad is blocked; so is a host without labels on a bad domain, and no other one."""
    rows = [(f"http://bad.example.com/{'de' if k % 10 else 'fr'}/{k}", None) for k in range(60)] + [(f"http://good{k % 5}.fine.com/fr/{k}", None) for k in range(400)] + [(f"http://good{k % 5}.fine.com/de/{k}", None) for k in range(20)]
    rows += [("http://bad.example.com:80/en/1", "block"), ("http://new.example.com/en/1", "block"), ("http://good1.fine.com/en", "allow"), ("http://new.fine.com/en", "allow"), ("http://other.net/en", "allow"), (None, "allow")] * 2
    pages = spark.createDataFrame([(k if k % 7 else None, u, w, "clash") for k, (u, w) in enumerate(rows)], "page_id long, url string, want string, host string")
    out = url_filter.filter_urls(pages).where("rule IS NULL").collect()
    assert len(out) == 12 and all(r.bad_low is not None for r in out)
    assert {(r.host, r.verdict) for r in out} == {(url_filter_host(u), w) for u, w in rows if w}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, u or "") for k, (u, _) in enumerate(rows)])
    sql = con.sql(f"SELECT host, verdict FROM ({url_filter.ORACLES['op3_url_filter']}) WHERE rule IS NULL").fetchall()
    assert sorted(sql) == sorted((r.host, r.verdict) for r in out)


def url_filter_host(url):
    return (url or "://").partition("://")[2].partition("/")[0]


def test_flow_is_cheapest():
    flow = reshard.min_cost_flow([7, 1, 4], [4, 4, 4], lambda i, j: int(i != j))
    assert sum(f for (i, j), f in flow.items() if i != j) == 3
    assert reshard.level([5, -3, 9], 11) == [4, 0, 7]


def sharded(spark, rows, files, **more):
    """The rows written as so many files, resharded; a column of them clashes with the operator's own."""
    path = shared_dir(spark)
    df = spark.createDataFrame([(*r, k % files, "clash") for k, r in enumerate(rows)], "doc_id long, text string, f int, shard string")
    for k in range(files):
        df.where(F.col("f") == k).drop("f").coalesce(1).write.mode("append").parquet(f"{path}/d{k}")
    docs = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return reshard.reshard(docs, **more).collect()


def test_equal_texts_share_a_shard(spark):
    rnd = random.Random(8)
    texts = [words(rnd, rnd.randrange(5, 120)) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for t in texts[:60]:  # groups over all files, some of them heavy
        rows += [(len(rows), t) for _ in range(rnd.choice((1, 2, 5, 30)))]
    rows += [(None, texts[0]), (None, None), (5, ""), (5, ""), (5, None)]
    rows += [(len(rows), "hot") for _ in range(9000)]  # more than a shard: has to be split
    rnd.shuffle(rows)
    got = sharded(spark, rows, 8)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(rows, key=key)
    where, size, group = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in got:
        where[r.text or ""].add(r.shard)
        size[r.shard] += len((r.text or "").encode()) + 1
        group[r.text or ""] += len((r.text or "").encode()) + 1
    mean = sum(size.values()) / 16
    assert len(where["hot"]) > 1 and sum(n > 2 * mean / reshard.HEAVY for n in group.values()) > 5
    assert all(len(where[t]) == 1 for t, n in group.items() if n <= mean / 2)
    assert set(size) == set(range(16)) and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert sharded(spark, [], 1) == [] and {r.shard for r in sharded(spark, [(1, "a")], 1)} == {0}


def test_moves_the_fewest_bytes(spark):
    """Texts of one size and old shards of uneven ones: the bytes moved are what the old shards have over the new capacity."""
    path = shared_dir(spark)
    counts = [640, 0, 100, 60] + [0] * 12
    for k, n in enumerate(counts):
        if n:
            spark.createDataFrame([(k * 1000 + j, f"{k:02d}-{j:05d}") for j in range(n)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/d{k}")
    docs = spark.read.option("recursiveFileLookup", "true").parquet(path)
    names = sorted(f.rsplit("/", 1)[-1] for f in docs.inputFiles())
    rows = reshard.reshard(docs, shards=4).collect()
    held, size = collections.Counter(r.old_shard for r in rows), collections.Counter(r.shard for r in rows)
    assert len(names) == 3 and set(size.values()) == {200}
    assert sum(r.shard != r.old_shard for r in rows) == sum(max(0, n - 200) for n in held.values())
    flow = reshard.min_cost_flow([held[k] for k in range(4)], [200] * 4, lambda i, j: int(i != j))
    best = min(sum(abs(x) for x in (held[0] - 200, held[1] - 200, held[2] - 200, held[3] - 200)) // 2, 10**9)
    assert sum(f for (i, j), f in flow.items() if i != j) == best


def test_heavy_groups_follow_the_flow():
    flow = {(0, 0): 100, (0, 1): 50, (2, 2): 30}
    room = [100, 60, 40]
    assert reshard.place_heavy([(0, 45), (0, 90), (2, 35)], flow, room) == [1, 0, 2]
    assert room == [10, 15, 5]


def test_shards(docs):
    rows = reshard.with_slots(reshard.reshard(docs).select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard")).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in corpus())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values()) and set(by) <= set(range(16))


MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"


def warc_pages():
    html = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\n" + MAGIC, "\r\n", "ends\r\n\r\n", MAGIC, "é" * 50, "\0 \U0001f600"] + [f"<i>{k}</i>" for k in range(40)]
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate(html)]
    rows += [(-5, "u", "<p>a</p>"), (-7, None, "alone"), (1, "u", "<p>b</p>"), (3, "u", "<p>b</p>"), (3, "v", "<p>b</p>"), (1, "w", "<p>b</p>"), (None, "u", "<p>b</p>")]
    return rows + [(None, "u", "no id"), (None, "v", "no id"), (0, "u", "B"), (1, "u", "A"), (1, "u", "B"), (9, "long", "l\r\n\r\n" * 30_000)]


def warc_by_hand(rows):
    groups = collections.defaultdict(list)
    for page_id, _, h in rows:
        groups[(h or "").encode()].append(page_id)
    want = []
    for raw, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want += [(str(x), len(raw), digest, "revisit" if k else "response", str(ids[0] if k else None)) for k, x in enumerate(ids)]
    return sorted(want)


def test_warc_query_with_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 500)  # records that span ranges, and many in one
    rows = warc_pages()
    spark.createDataFrame([(*r, 1, "clash") for r in rows], "page_id long, url string, html string, at int, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op6_warc(spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == warc_by_hand(rows)
    unique = [r for k, r in enumerate(rows) if r[0] is not None and (r[0], r[2]) not in {(x[0], x[2]) for x in rows[:k]}]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r for r in unique if "\0" not in (r[2] or "")])
    sql = con.sql(warc.ORACLES["op6_warc"]).fetchall()
    assert sorted((str(a), b, c, d, str(e)) for a, b, c, d, e in sql) == warc_by_hand([r for r in unique if "\0" not in (r[2] or "")])
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op6_warc(spark, f"{tmp_path}/none").count() == 0


def test_warc_archives(spark, monkeypatch):
    """Other readers can use the files: a gzip member a record, the fields that the standard asks for, payloads whole."""
    rows = warc_pages()
    path = shared_dir(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, min_bytes=5, date="2024-01-02T03:04:05Z")
    found, members = [], 0
    for name in glob.glob(path.removeprefix("file://") + "/*.warc.gz"):
        data, plain = open(name, "rb").read(), b""
        while data:
            own = zlib.decompressobj(31)
            plain += own.decompress(data)
            members += 1
            assert own.eof
            data = own.unused_data
        while plain:
            head, _, rest = plain.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n" and fields["WARC-Date"] == "2024-01-02T03:04:05Z"
            found.append((fields, rest[:n]))
            plain = rest[n + 4 :]
    assert len(found) == len(rows) and members == len(rows)
    monkeypatch.setattr(warc, "_MEMBER", 1000)  # a larger record takes several members that read as one
    batch = warc.pa.RecordBatch.from_pydict({"value": [b"a" * 1000, b"b" * 3500]})
    parts = [x + b"\0" for b in warc._members(iter([batch])) for x in b.column(0).to_pylist()]
    assert [gzip.decompress(x) for x in parts] == [b"a" * 1000, b"b" * 3500]
    names = [f["WARC-Record-ID"] for f, _ in found]
    assert len(set(names)) == len(names)
    by_name = {f["WARC-Record-ID"]: (f, x) for f, x in found}
    for f, _ in found:
        if f["WARC-Type"] == "revisit":
            first = by_name[f["WARC-Refers-To"]]
            assert first[0]["WARC-Type"] == "response" and first[0]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and f["WARC-Profile"] == warc.REVISIT
    small = [(r.page_id, bytes(r.payload)) for r in warc.read_warc(spark, path).collect() if len(r.payload) < 5 and r.record_type == "response"]
    assert sorted(map(str, small)) == sorted(str((i, (h or "").encode())) for i, _, h in rows if len((h or "").encode()) < 5)


def test_languages(spark):
    rnd = random.Random(2)
    kinds = {"xx": "ba be bi bo bu da de".split(), "yy": "tsch pfr straß über".split()}
    rows = [(k, " ".join("".join(rnd.choices(kinds[x], k=3)) for _ in range(30)), x) for k, x in enumerate(["xx", "yy"] * 30)] + [(900, None, "xx"), (901, "12 !!", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows[:60]) and got[900].lang_pred == got[901].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df, langid.train(df.limit(0))).where("lang_pred != 'und'").count() == 0


def test_language_models_as_tables_leave_no_gram_out(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(k // 2 if k % 7 else None, " ".join("".join(rnd.choices(x, k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(40))), name) for k, (name, x) in enumerate([("xx", "abcdefgh"), ("yy", "efghijßü日本")] * 40)]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 !!", "yy"), (902, "qqq abc", None)], "doc_id long, text string, lang string")
    held = langid.train(df)
    monkeypatch.setattr(langid, "HELD_CELLS", 0)
    monkeypatch.setattr(langid, "MAX_GRAMS", 100, raising=False)
    tables = langid.train(df)
    assert isinstance(tables, langid.Tables) and sum(map(len, held.keys)) > 500
    # every n-gram that the models know, and some that they do not
    grams = np.concatenate([held.keys[-1], langid.gram_keys([b"zzz", b"abz", "日z".encode(), b"ghab"])[0]])
    got = {r.gram: r.logp for r in tables.log_probabilities(spark.createDataFrame([(int(x),) for x in grams.view(np.int64)], "gram long")).collect()}
    assert np.allclose([got[int(x)] for x in grams.view(np.int64)], held.letters(grams))
    key = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 4), r.rejected)
    assert sorted(map(key, langid.identify(df, tables).collect())) == sorted(map(key, langid.identify(df, held).collect()))
    exact = lambda models: sorted((str(r.doc_id), r.lang_pred, r.score, r.rejected) for r in langid.identify(df, models).collect())
    assert exact(tables) == exact(held) and tables.temperature == held.temperature and list(tables.limits) == list(held.limits)


def test_language_calibration_takes_all_training_rows(spark):
    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choices(["abcdefgh", "efghijkl"][k % 5 > 2], k=rnd.randrange(1, 12))), ["xx", "yy"][k % 5 > 2]) for k in range(9000)]
    df = spark.createDataFrame([*rows, (9002, "日本", "zz"), (9003, None, "xx"), (None, "abc", "xx")], "doc_id long, text string, lang string")
    models = langid.train(df)
    used = [r for r in [*rows, (9002, "日本", "zz")] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sums = models.words([r[1].encode() for r in used])
    letters, truth = sums[:, -1].astype(float), np.array([models.langs.index(r[2]) for r in used])
    best, entropy, x = langid._margins(letters, sums[:, :-1] / langid.UNIT)
    grid = [0.25, 0.5, 1, 2, 4]
    loss = [-np.log(np.maximum(langid._softmax(t * x)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    assert len(used) > 6000 and models.temperature == grid[int(np.argmin(loss))]
    expected = [np.quantile(entropy[best == k], 0.999) + 0.25 if (best == k).sum() >= 20 else np.inf for k in range(len(models.langs))]
    assert np.allclose(models.limits, expected, rtol=0, atol=2 / langid.UNIT)
    found = [sorted(map(str, x.collect())) for x in (langid.train_identify(df), langid.identify(df, models))]
    assert found[0] == found[1] and len(found[0]) == len(rows) + 3 and any("rejected=True" in x for x in found[0])


def test_a_language_whose_texts_have_no_letters(spark):
    df = spark.createDataFrame([(1, "abc abd", "xx"), (3, "12", "zz"), (4, "bca", "yy")], "doc_id long, text string, lang string").coalesce(1)
    assert langid.train(df).langs == ["xx", "yy"]


def test_letter_probabilities_sum_to_one():
    m = langid.build({"a": tuple(np.unique(langid.gram_keys([b"abab", b"ba", b"abc"])[0], return_counts=True))})
    context = np.uint64(ord("a") << 16 | ord("b")) << np.uint64(16)
    known = [ord(c) for c in "abc"] + [1]
    assert sum(np.exp(m.letters(np.array([context | np.uint64(c)]))[0, 0]) for c in known) == pytest.approx(1, abs=0.06)


def components_by_hand(rows):
    sets = {}
    for doc_id, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = [k for k in sets if k is not None]
    comp = {k: k for k in ids}

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in ids}


def test_near_duplicates(docs, empty):
    want = components_by_hand(corpus())
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    assert want == {k: (got[k].n_shingles, got[k].component_id) for k in want}
    assert got[None].component_id is None
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {k for k in want if want[k][1] == k} | {None}


def test_links_that_no_star_has(spark, monkeypatch):
    """Windows of one long text: neighbours link, far ones only share grams; tries are small, so that blocks and bands matter."""
    monkeypatch.setattr(ngram_join, "TRIE_ROWS", 40)
    rnd = random.Random(6)
    rows = []
    for _ in range(4):
        long = words(rnd, 500).split()
        for k in range(0, 400, 5):
            rows.append((rnd.randrange(10**6), " ".join(long[k : k + rnd.choice((30, 40, 60, 64, 90))])))
        shared = " ".join(long[:60])  # a passage that many different texts share
        rows += [(rnd.randrange(10**6), words(rnd, rnd.randrange(5, 60)) + " " + shared + " " + words(rnd, rnd.randrange(5, 60))) for _ in range(25)]
        rows += [(rnd.randrange(10**6), shared + " " + words(rnd, 3)) for _ in range(10)]
    rows = list({r[0]: r for r in rows}.values())
    want = components_by_hand(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 100 and max(collections.Counter(c for _, c in want.values()).values()) > 10


def test_prefix_trie_walk():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        n = rnd.integers(10, 60, 60)
        sets = [np.sort(rnd.choice(np.arange(rnd.choice((70, 200))), k, replace=False)) for k in n]
        comp, base = rnd.integers(0, 3, 60), rnd.random(60) < 0.5

        def rows(ids):
            own = [(int(x), k, place, int(n[k]), int(comp[k]), bool(base[k])) for k in ids for place, x in enumerate(sets[k][: ngram_join.prefix_size(int(n[k]))])]  # noqa: B023
            return [np.array(c, t) for c, t in zip(zip(*own, strict=True), (np.int64, np.int64, np.int32, np.int32, np.int64, bool), strict=True)]

        trie = ngram_join.PrefixTrie(*rows(range(60)))
        got = sorted(x for part in trie.walk(*rows(range(30))[:5]) for x in zip(*(c.tolist() for c in part), strict=True))
        want = []
        for a in range(30):
            for b in range(60):
                need = int(ngram_join.least_overlap(int(n[a]), int(n[b])))
                if comp[a] != comp[b] and (base[b] or a < b) and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b]):
                    for x in set(sets[a][: n[a] + ngram_join.ELL - need]) & set(sets[b][: n[b] + ngram_join.ELL - need]):
                        p, q = int(np.searchsorted(sets[a], x)), int(np.searchsorted(sets[b], x))
                        if p < ngram_join.prefix_size(int(n[a])) and q < ngram_join.prefix_size(int(n[b])):
                            want.append((a, b, int(n[a]), int(n[b]), p, q) if a < b else (b, a, int(n[b]), int(n[a]), q, p))
        assert got == sorted(want)


def test_trie_walk():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 50))).astype(np.uint64) for _ in range(80)]
    head = np.arange(100, 130, dtype=np.uint64)  # sets that share a path and differ behind it
    sets += [np.concatenate([head[:k], 1000 + np.unique(rnd.integers(0, 90, rnd.integers(1, 30))).astype(np.uint64)]) for k in rnd.integers(5, 30, 80)]
    trie = ngram_join.Trie(sets)
    for p in sets[:20] + sets[80:110]:
        assert sorted(trie.overlapping(p)) == [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(p, s)) >= 75 * len(np.union1d(p, s))]


def test_pu_learning():
    rnd = np.random.default_rng(0)
    good, bad = rnd.normal(0, 1, (1500, 4)), rnd.normal(4, 1, (300, 4))
    model = pu_quality.fit(good[:700], np.concatenate([good[700:], bad]), (np.concatenate([good[:200], bad[:50]]), np.r_[np.ones(200), np.zeros(50)]))
    assert abs(model.prior - 800 / 1100) < 0.12
    assert (model.score(good) >= 0.7).mean() > 0.95 and (model.score(bad) >= 0.7).mean() < 0.05


def test_pu_scores(spark, docs, empty):
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = pu_quality.train(docs, labels)
    got = pu_quality.score(docs, model).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert pu_quality.train(empty, labels) is None and pu_quality.score(empty, None).count() == 0
    assert pu_quality.keep_good(docs, model).columns == docs.columns


def test_pu_statistics_cover_all_texts(spark):
    """With a sample of 60 rows of each kind, quantiles and the unlabelled mass are still those of all training texts."""
    texts = [(k, "| # 1 2 $ " * (k % 40 + 3) if k % 5 == 0 else " ".join(f"word{k * j % 97} reads" for j in range(k % 50 + 10))) for k in range(3000)]
    docs = spark.createDataFrame([*texts, *texts[:200], (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(0, 3000, 2)], "doc_id long, quality int")
    model = pu_quality.train(docs, labels, rows=60)
    kept = [t for k, t in [*texts, *texts[:200]] if zlib.crc32(str(k).encode()) % 4 != 2]
    x, points = np.array([pu_quality.describe(t) for t in kept]), pu_quality.cut_points(len(kept))
    assert model.cuts.shape == (pu_quality.FEATURES, len(points))
    for cuts, column in zip(model.cuts, x.T, strict=True):
        column = np.sort(column)
        for c, q in zip(cuts, points, strict=True):
            lo, hi = np.searchsorted(column, c, "left"), np.searchsorted(column, c, "right")
            assert lo - 2 <= q * len(column) <= hi + 2
    assert abs(model.prior - 0.8) < 0.15  # the least ratio over thresholds set by 60 positives: a low estimate
    got = pu_quality.score(docs, model).where("doc_id IS NOT NULL").collect()
    assert sum(r.predicted == int(r.doc_id % 5 > 0) for r in got) > 0.97 * len(got)
    again = pu_quality.train(docs.repartition(5), labels, rows=60)
    assert np.allclose(again.weights, model.weights) and again.prior == model.prior


def test_encoding(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.byte_bpe_path())
    rows = [r for r in corpus() if r[0] not in (None, 3)]
    want = {r[0]: tk.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    got = {r.doc_id: r for r in bpe.round_trip(docs, bpe.byte_bpe_path()).collect()}
    for k, t, *_ in rows:
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(want[k]), hashlib.sha256(",".join(map(str, want[k])).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoded = bpe.encode_documents(docs.where("doc_id != 3"), bpe.byte_bpe_path())
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, bpe.byte_bpe_path()).collect()} == {r[0]: r[1] or "" for r in rows}


def best_fit_by_hand(sizes, capacity):
    free, bins = [], []
    for x in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(free) if room >= x]
        if fits:
            k = min(fits, key=lambda k: free[k])
        else:
            k = len(free)
            free.append(capacity)
            bins.append([])
        free[k] -= x
        bins[k].append(x)
    return sorted(map(tuple, bins))


def test_best_fit_of_counts():
    rnd = random.Random(7)
    for _ in range(150):
        capacity = rnd.randrange(1, 60)
        sizes = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(80))]
        placed, bins = packing.best_fit(collections.Counter(sizes), capacity)
        got, seen = collections.defaultdict(list), collections.Counter()
        for size, lo, hi, first, each, base in placed:
            assert lo == seen[size]
            seen[size] = hi
            for k in range(hi - lo):
                assert sum(got[first + k // each]) == base + k % each * size
                got[first + k // each].append(size)
        assert seen == collections.Counter(sizes)
        assert sorted(sum(x) for x in got.values()) == sorted(sum(x) for x in best_fit_by_hand(sizes, capacity))  # which of equal bins takes an item is open
        assert sorted(sum(x) for x in got.values()) == sorted(f for a, b, f in bins for _ in range(b - a))


def test_no_bin_is_closed_early(spark):
    """Bins that only fit with bins of other groups, through all levels, however many there are."""
    n = 1200
    rows = [(k, 0, 0, 1500 if k % 2 else 548, 0) for k in range(n)] + [(None, 0, 0, 700, 0)] * 6
    items = spark.createDataFrame(rows, packing._PIECE)
    for own in (7, 300):  # 7: every group has a few pieces, 173 groups, 4 levels
        got = packing.pack(items, per_group=own).collect()
        assert len(got) == n + 6
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own_rows in bins.values():
            at = 0
            for offset, length in sorted(own_rows):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= 1.1 * (n // 2 + 3)  # groups of 7 pieces pair some small ones with each other
    halves = spark.createDataFrame([(k, 0, 0, 1200 if k < 300 else 848, 0) for k in range(600)], packing._PIECE)
    assert packing.pack(halves, per_group=50).select("sequence_id").distinct().count() <= 330


def test_long_words_merge_exactly(spark, empty):
    from tokenizers import Tokenizer

    tk, own, rnd = Tokenizer.from_file(bpe.byte_bpe_path()), bpe.load(bpe.byte_bpe_path()), random.Random(9)
    texts = ["ab" * 3000, "a" * 5000, "xyx" * 700] + ["".join(rnd.choice(a) for _ in range(rnd.randrange(300, 4000))) for a in ("ab", "the", "aeiouxyz", "éüaßn") for _ in range(5)]
    for t in texts:
        want = tk.encode(t, add_special_tokens=False).ids
        assert own.merge_long(t.encode()) == want == own.merge([t.encode()])[0]
    began = time.time()
    own.merge_long(b"ab" * 100_000)
    assert time.time() - began < 5  # n log n; a scan for each merge takes over a minute
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in bpe.round_trip(rows, bpe.byte_bpe_path()).collect()} == {k: len(tk.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert bpe.round_trip(empty, bpe.byte_bpe_path()).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.byte_bpe_path())
    got = packing.pack(packing.pieces(docs.where("doc_id IS NOT NULL"), bpe.byte_bpe_path()), per_group=5).collect()
    ids = {r[0]: [*tk.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in corpus() if r[0] is not None}
    assert sum(r.length for r in got) == sum(map(len, ids.values())) + len(ids[3])
    bins = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048) == [(0, 2048)] and packing.cut(1) == [(0, 1)]
    assert packing.pack(packing.pieces(empty, bpe.byte_bpe_path())).count() == 0


DATA = "/root/testdata/sf0.01"


def held_out_rows(spark, name, query, data=DATA):
    """(row of the query, row of the table) of the held-out fold; the fold and the number of rows are checked."""
    got = query(spark, data).collect()
    table = {r.doc_id: r for r in spark.read.parquet(f"{data}/{name}.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in got:
        assert not hasattr(r, "held_out") or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    return [(r, table[r.doc_id]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in table]


def test_languages_of_the_held_out_fold(spark):
    rows = [(r, d) for r, d in held_out_rows(spark, "documents", langid.op5_langid) if d.lang and any(c.isalpha() for c in d.text or "")]
    assert len(rows) > 100 and sum(r.lang_pred == d.lang for r, d in rows) > 0.98 * len(rows)


def test_quality_of_the_held_out_fold(spark):
    rows = [(r, d) for r, d in held_out_rows(spark, "labels", pu_quality.op8_pu_quality, "/root/testdata/sf0.1") if d.quality is not None]
    assert len(rows) > 50 and sum(r.predicted == d.quality for r, d in rows) > 0.95 * len(rows)
    good, bad = ([r.score for r, d in rows if d.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)


def test_learned_rules_on_the_held_out_fold(spark):
    rows = [(r, d) for r, d in held_out_rows(spark, "labels", quality_rules.op1_quality_rules, "/root/testdata/sf0.1") if d.quality is not None and not r.base_failed]
    good, bad = ([r.kept for r, d in rows if d.quality == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_pipeline_stage_by_stage(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["quality_rules", "quality_classifier", "exact_dedup", "ngram_join", "packing"]
    key = lambda r: (str(r.doc_id), r.text or "", r.lang or "", r.source)
    before = docs
    for name in names[:-1]:
        after = stage[name](spark, before, str(tmp_path))
        assert after.columns == docs.columns
        rows, kept = before.collect(), collections.Counter(map(key, after.collect()))
        if name == "quality_rules":
            def fails(t):
                w = WORD.findall(t or "")
                win = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
                covered = {p for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
                return len(w) < 20 or 100 * len(covered) > 30 * len(w)

            learned = quality_rules.learn_rules(quality_rules.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
            rejected = {key(r) for r in rows if fails(r.text)}
            assert not rejected & set(kept) and (learned or set(kept) == {key(r) for r in rows} - rejected)
            before = docs  # few pass; the next stages are tried on all rows
            continue
        if name == "quality_classifier":
            model = pu_quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            score = {key(r): model.score(np.array([pu_quality.describe(r.text or "")]))[0] for r in rows}
            assert kept == collections.Counter(key(r) for r in rows if score[key(r)] >= 0.7)
            before = docs
            continue
        if name == "exact_dedup":
            groups = collections.defaultdict(list)
            for r in rows:
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
            want = collections.Counter(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
            assert collections.Counter(r.doc_id is None and "None" or str(r.doc_id) for r in after.collect()) == want
        if name == "ngram_join":
            top = components_by_hand([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id for r in after.collect()} == {k for k, (_, c) in top.items() if c == k} | {r.doc_id for r in rows if r.doc_id is None}
        before = spark.createDataFrame(after.collect(), docs.schema)
    got, tk = stage["packing"](spark, before, "").collect(), Tokenizer.from_file(bpe.byte_bpe_path())
    ids = collections.Counter()
    for r in before.collect():
        ids[str(r.doc_id)] += len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in got:
        packed[str(r.doc_id)] += r.length
    assert packed == ids
    for name in names:
        assert stage[name](spark, empty, str(tmp_path)).count() == 0
