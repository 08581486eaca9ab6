"""Spelling variants, hard negatives and reply trees against brute force, and earlier operators on repeated ids and rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import hard_negatives, ngram_join, packing, quality_rules, reply_trees, reshard, spelling
from graphlens.llm.bpe import byte_bpe_path
from graphlens.llm.common import shared_dir

# -- spelling ---------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("frequent", "alphabet"), [(2, "ab"), (1, "abé"), (8, "abcdefg"), (10**6, "abcd")])
def test_variants(spark, monkeypatch, frequent, alphabet):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    rnd = random.Random(frequent)
    counts = {}
    for _ in range(150):
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.choice((6, 6, 7, 7, 8, 9, 14))))
        counts[w] = rnd.choice((5, 6, 30, 31, 150, 800))
        k = rnd.randrange(len(w))
        for x in (w[:k] + rnd.choice(alphabet) + w[k:], w[:k] + rnd.choice(alphabet) + w[k + 1 :]):
            if len(x) >= 6:
                counts.setdefault(x, rnd.choice((5, 9, 40, 700)))
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.group_variants(df, 6).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str) == variants(counts)


def test_one_edit_leaves_a_list(spark):
    """Each near pair meets in a list that the first word chooses, whatever grams are frequent."""
    rnd = random.Random(9)
    longest = spelling.longest_for(6)
    for _ in range(3000):
        alphabet = rnd.choice(("ab", "abcd"))
        frequent = {"".join(rnd.choice(alphabet + spelling.BEGIN + spelling.END) for _ in range(rnd.choice((2, 3)))) for _ in range(rnd.randrange(30))}
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(6, 12)))
        k = rnd.randrange(len(a) + 1)
        b = rnd.choice((a[:k] + rnd.choice(alphabet) + a[k:], a[:k] + rnd.choice(alphabet) + a[k + 1 :], a[:k] + a[k + 1 :]))
        if len(b) < 6 or a == b:
            continue
        text = spelling.BEGIN + b + spelling.END
        grams = spelling.decompose(b, frequent, longest)
        heads, tails = {text[: e + 1] for _, e in grams}, {text[p:] for p, _ in grams}
        options = spelling.pairs_of_lists(a, spelling.decompose(a, frequent, longest), longest)
        assert options
        assert all(x in heads or y in tails for x, y in options)


def test_typed_words(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(("Überall", "übERALL", "garden", "gardens", "x1234567", "longword_longword", "short")) for _ in range(40))) for k in range(120)]
    rows += [(None, "garden garden"), (5, None), (6, ""), (7, "gardens"), (7, "gardens")]
    counts = collections.Counter()
    letter = lambda c: c.isascii() and c.isalpha() or "À" <= c <= "ÿ"
    for doc, text in rows:
        for run in "".join(c if letter(c) else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.typed_words(df.withColumn("word", F.lit("clash"))).collect()} == want
    assert spelling.group_variants(spelling.typed_words(df.limit(0)), 6).count() == 0


# -- hard negatives ---------------------------------------------------------


def test_residue_product_is_exact():
    rnd = np.random.default_rng(1)
    for size, top in ((1, 10), (64, 300), (130, 100_000), (257, 1_000_000)):
        a, b = rnd.integers(-top, top + 1, (7, size)), rnd.integers(-top, top + 1, (9, size))
        a[0], b[0] = top, -top  # the largest score of all, negative
        primes = hard_negatives.primes_for(float(size) * top * top)
        got = hard_negatives.multiply(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert (got == a @ b.T).all()
    assert all(hard_negatives.DEPTH * (p // 2) ** 2 < 1 << 24 for p in hard_negatives.PRIMES)
    assert math.prod(hard_negatives.PRIMES[: len(hard_negatives.primes_for(hard_negatives.MOST))]) < 1 << 63


def mined(rows, top=5):
    last = lambda i: (i is None, i or 0)
    ok = []
    for uid, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((uid, i, [math.floor(256 * x) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for uid, i, v, label in ok:
        if i is None or i % 10:
            continue
        scored = [(dot(v, w), j, other, u) for u, j, w, other in ok if u != uid]
        best = sorted((x for x in scored if x[2] == label), key=lambda x: (-x[0], last(x[1])))[:top]
        for p, pid, *_ in best:
            fits = sorted((x for x in scored if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=lambda x: (-x[0], last(x[1])))[:top]
            out += [(i, pid, k + 1, x[1], p, x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "slice_", "tile", "block"), [(16_384, 8_192, 512, 2_048), (5, 40, 2, 7)])
def test_mining(spark, monkeypatch, group, slice_, tile, block):
    for name, value in (("GROUP", group), ("SLICE", slice_), ("TILE", tile), ("BLOCK", block)):
        monkeypatch.setattr(hard_negatives, name, value)
    rnd = random.Random(7)
    centre = [[rnd.gauss(0, 0.3) for _ in range(6)] for _ in range(3)]
    vector = lambda: [round(c + rnd.gauss(0, 0.1), 2) for c in rnd.choice(centre)]
    rows = [(k, vector(), rnd.choice((0, 0, 0, 1, 2))) for k in range(220)]
    rows += [(220 + k, rows[10][1], 0) for k in range(12)] + [(240 + k, rows[10][1], 1) for k in range(12)]  # ties
    rows += [(30, vector(), 0), (30, vector(), 1), (30, rows[30][1], rows[30][2]), (None, vector(), 0), (None, vector(), 1)]  # repeated and null ids
    rows += [(300, None, 1), (310, vector(), None), (320, [1.0, None], 1), (330, [float("nan")], 1), (340, [float("inf")], 0), (350, [], 0), (360, [0.5, -0.25], 1), (370, vector(), 9)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0).collect()), key=str)
    assert got == mined(rows)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError, match="2\\^51"):
        hard_negatives.mine(spark.createDataFrame([(0, [1e9], 1)], df.drop("score").schema), F.lit(True))


# -- reply trees ------------------------------------------------------------


def test_paths_of_trees(spark):
    rnd = random.Random(2)
    rows, tree = [], {}
    for t in [1, 2, 3, None]:
        for m in range(30 if t != 3 else 70):
            parent = None if m == 0 or rnd.random() < 0.05 else rnd.randrange(max(0, m - 3), m) if t != 3 else m - 1
            tree[t, m] = (parent, round(rnd.random(), 3))
            rows.append((t, m, parent, "user" if m % 2 else "assistant", f"t{m}", tree[t, m][1]))
    rows += [(1, 900, 12345, "user", "orphan", 0.5), (1, 901, 902, "user", "ring", 1.0), (1, 902, 901, "user", "ring", 1.0), (1, 900, 12345, "user", "orphan", 0.5), (2, None, None, None, None, None)]
    tree[1, 900], tree[2, -1] = (12345, 0.5), (None, 0.0)

    def up(t, m):
        out = []
        while (t, m) in tree:
            out.append(m)
            m = tree[t, m][0]
        return out[::-1]

    parents = {(t, p) for (t, _), (p, _) in tree.items()}
    want = collections.defaultdict(list)
    for t, m in tree:
        if (t, m) not in parents:
            path = up(t, m)
            want[t].append((-sum(tree[t, x][1] for x in path) / len(path), m, path))
    df = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double").withColumn("place", F.lit("clash")).repartition(4)
    for best in (1, 2, None):
        got = collections.defaultdict(list)
        for r in reply_trees.paths(df, best).collect():
            got[r.tree_id, r.leaf].append((r.place, r.text))
        chosen = {(t, m): path for t, found in want.items() for _, m, path in sorted(found)[:best]}
        assert {k: sorted(v) for k, v in got.items()} == {k: [(i, {900: "orphan", -1: ""}.get(m, f"t{m}")) for i, m in enumerate(path)] for k, path in chosen.items()}
    assert reply_trees.paths(df.limit(0)).count() == 0


def test_format_is_read_back(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<<SYS>><</SYS>>", "[/ANS][ANS]", "[[/INST]", "<", "<</s>", "a\nb", "é日😀 </s>", "x" * 50_000, "[/TURN]", "$1 \\$0"]
    roles = ["user", "assistant", "system", "tool [/ROLE]", None, ""]
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(roles), rnd.choice(odd)) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(50, t, "assistant", odd[t]) for t in range(len(odd))] + [(60, 0, "user", "b"), (60, 0, "user", "a"), (60, 0, "user", "a"), (60, None, "assistant", "first"), (None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(0)).repartition(5)
    out = reply_trees.format_turns(reply_trees.paths(reply_trees.conversations_as_trees(df)), ["tree_id", "leaf"])
    got = out.select("tree_id", "formatted", "loss", reply_trees.read_turns(F.col("formatted")).alias("turns"), reply_trees.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert {r.tree_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        turns = [(role, text) for _, role, text in sorted(by[r.tree_id])]
        assert [(x.role, x.text) for x in r.turns] == turns
        assert r.learned == "".join(text for role, text in turns if role == "assistant")
        raw = r.formatted.encode()
        assert all(b"\\" in raw[s.start : s.start + s.bytes] or raw[s.start : s.start + s.bytes].decode() in [t for _, t in turns] for s in r.loss)
        inside = r.formatted[len("<s>") : -len("</s>")]
        assert "<s>" not in inside and "</s>" not in inside


def test_chat_query_adds_the_probe(spark, tmp_path):
    spark.createDataFrame([(4, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in reply_trees.op13_chat_format(spark, f"file://{tmp_path}").collect()}
    probe = "</s>[INST] ok [/INST]"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars, got[-1].loss_sha256) == (2, sha(f"user\n{probe}\nassistant\n{probe}\n"), len(probe), sha(probe))
    assert (got[4].n_turns, got[4].turns_sha256, got[4].loss_chars, got[4].loss_sha256) == (1, sha("user\n\n"), 0, sha(""))


# -- earlier operators on repeated ids and rows -----------------------------


def linked(rows):
    grams = []
    for _, text in rows:
        w = (text or "").lower().split()
        grams.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    least = {d: d for d, _ in rows}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and 100 * both >= 75 * len(grams[i] | grams[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                least[b] = a
    return {d: find(d) for d in least}


def test_links_of_ids_with_several_texts(spark):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10_000)}"
    rows = []
    for k in range(30):  # one text equals another id's, the other shares its last gram only with a third
        one, tail = word(), [word() for _ in range(5)]
        rows += [(k, one), (k, " ".join([word(), word(), *tail])), (100 + k, one), (200 + k, " ".join([*(word() for _ in range(4)), *tail]))]
    for k in range(20):  # near texts of ids with up to four texts
        base = [word() for _ in range(rnd.randrange(20, 60))]
        for _ in range(3):
            rows.append((300 + rnd.randrange(25), " ".join(base[: len(base) - rnd.randrange(3)])))
    rows += [(400, None), (400, ""), (400, rows[0][1]), (401, None), (300, rows[0][1]), (0, rows[0][1])]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = ngram_join.near_duplicates(df).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == linked(rows)


def test_long_white_space_is_packed(spark):
    from tokenizers import Tokenizer

    texts = [" " * 1_000_000, "\n" * 1_000_001, "a" + " \n\t" * 333_334 + "b", "x" * 100_000, " " * 30_000 + "end", "　" * 25_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pieces(df, byte_bpe_path()).collect():
        got[r.doc_id].append(r)
    whole = Tokenizer.from_file(byte_bpe_path())
    whole.no_truncation()
    whole.no_padding()
    for k, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for r in got[k]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in got[k]) == len(ids)


def test_repeated_ids_are_dealt_over_all_groups(spark):
    items = spark.range(20_000).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "id % 700 + 1 length", "id ids_crc32").repartition(4)
    out = packing.pack(items, per_group=4_000).cache()
    seen = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    total = sum(k % 700 + 1 for k in range(20_000))
    assert out.count() == 20_000 and seen[0] <= 2048 and seen[1] == total and seen[2] <= math.ceil(total / 2048) * 1.02
    level = out.withColumn("group", F.shiftright("sequence_id", 34).bitwiseAND(F.lit((1 << 24) - 1))).where(F.shiftright("sequence_id", 58) == 1)
    assert level.select("group").distinct().count() == 5


def test_repeated_rows_are_split_between_shards(spark):
    rows = [(7, "the same text of some length")] * 2000 + [(k, f"other text {k:06d} of some length") for k in range(2000)]
    path = shared_dir(spark)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    for docs in (spark.read.parquet(path), spark.createDataFrame(rows, "doc_id long, text string")):
        out = reshard.reshard(docs, 16).select("shard", "doc_id", F.octet_length("text").alias("n")).cache()
        assert out.count() == len(rows)
        sizes = collections.Counter({r[0]: r[1] for r in out.groupBy("shard").agg(F.sum(F.col("n") + 1)).collect()})
        mean = sum(sizes.values()) / 16
        assert len(sizes) == 16 and max(abs(x - mean) for x in sizes.values()) < 0.15 * mean


def test_conflicting_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * 30) for k in range(40)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(k, 0) for k in range(0, 40, 4)] + [(None, 0), (1, None)], "doc_id long, quality int")
    got = quality_rules.labelled_sample(docs, labels).collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    assert sorted((r.doc_id, r.bad) for r in got) == sorted((k, k % 4 == 0) for k in range(40) if not held(k))
