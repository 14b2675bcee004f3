"""Each operator against brute force, and with nulls, empty and repeated rows and empty tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelmill.llm import components, decontaminate, encoder, exact_dedup, html_text, language, mixing, quality, simhash_dedup, substring_dedup, textops, token_counts, token_output

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, digest int, _id long, _keep long, key long, row string"
WORDS = "the of and to in is a that it was for on as with be by at from".split()


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, 2, 3, 4, "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.integers(30)) for _ in range(n))
    base = [text(int(n)) for n in rng.integers(1, 120, 60)]
    out = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    out += [(100 + i, base[i] if i % 2 else base[i].replace(" ", "\n", 1) + " ", "en", "s1") for i in range(20)]
    out += [(200 + i, text(10) + " " + " ".join(base[5].split()[:40]) + " " + text(8), None, None) for i in range(8)]
    out += [(300, None, None, None), (301, "", "en", "s0"), (302, " \n\t", "en", "s0"), (303, "123 !!", "en", "s2"), (None, "null id", "en", "s2"), (None, None, None, None)]
    return out + [out[0], out[7], (304, "word " * 30_000, "en", "s3")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(docs, rows, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0, i))
    best = {k: min(v, key=lambda x: x[:3])[3] for k, v in groups.items()}
    want = Counter((i, best[key(t)], len(groups[key(t)])) for i, t, *_ in rows)
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert exact_dedup.survivors(docs).count() == len(groups) and exact_dedup.survivors(docs).columns == docs.columns
    weak = exact_dedup.exact_dedup(docs, digest=lambda c: F.substring(F.md5(c), 1, 1)).collect()  # contents that share a digest
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in weak) == want


def test_simhash(docs, rows, empty):
    assert simhash_dedup.simhash_classes(empty).count() == 0

    def brute(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [brute(r[1]) for r in rows]
    hexed = simhash_dedup.simhash_classes(docs).select("doc_id", simhash_dedup.hexadecimal(F.col("fp")).alias("fp")).collect()
    assert Counter((r.doc_id, r.fp) for r in hexed) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fp))
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 4:
            parent[find(b)] = find(a)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), 1 << 60))
    want = Counter((r[0], least.get(find(k))) for k, r in enumerate(rows))
    for split in (20_000, 3):
        got = simhash_dedup.simhash_classes(docs, split=split).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == want
    assert simhash_dedup.near_dedup(docs).count() == len({find(k) for k in range(len(rows))})


def test_links_by_any_number_of_blocks(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 63, rng.integers(0, 6)).tolist())) for b in base for _ in range(6)})
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    closure = lambda links: {(r.node, r.root) for r in components.components(spark.createDataFrame(list(links), "a long, b long")).collect()}
    for shared in (2, 3, 4):
        got = [(r.a, r.b) for r in simhash_dedup.links(nodes, shared=shared).collect()]
        assert all((min(p), max(p)) in want for p in got) and closure(got) == closure(want)
    assert simhash_dedup.shared_blocks(10**6, 4) == 2 and simhash_dedup.shared_blocks(2 * 10**10, 4) == 3


def test_simhash_dense_group():
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    fp = np.array(sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (200, 3))}), np.uint64)
    table = simhash_dedup.pivot_table(fp, simhash_dedup.pivots())
    forest = simhash_dedup._explore(fp, table, None, 4)
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in forest)
    seen = set(range(len(fp)))
    parts = 0
    while seen:
        parts += 1
        queue = [seen.pop()]
        while queue:
            x = queue.pop()
            near = {y for y in seen if (int(fp[x]) ^ int(fp[y])).bit_count() <= 4}
            seen -= near
            queue += near
    assert len(forest) == len(fp) - parts


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (20, 1), (2, 1)]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (20, 1), (7, 7), (8, 7), (9, 7)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window, gram", [(20, 3), (5, 2), (1, 1)])
def test_substring(docs, rows, empty, window, gram):
    assert substring_dedup.substring_dedup(empty).count() == 0
    order = sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in rows})
    owners = Counter(k for k, _ in order)
    assert max(v for k, v in owners.items() if k >= 0) == 1
    seen, gone = set(), {}
    for k, t in order:
        w = words(t)
        out = gone[k, t] = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                out.update(range(i, i + window))
            seen.add(x)
    keep = lambda k, t: " ".join(x for i, x in enumerate(words(t)) if i not in gone[k, t])
    want = Counter((r[0], keep(r[0], r[1] or "")) for r in rows if r[0] is not None)
    got = substring_dedup.substring_dedup(docs, window, gram).filter("doc_id is not null").collect()
    assert Counter((r.doc_id, r.kept_text) for r in got) == want


def test_repeats_survives_hash_collisions():
    values = [b"a", b"b", b"a", b"b", b"c", b"a"]
    later, first = textops.repeats(np.zeros(6, np.uint64), values.__getitem__)
    assert sorted(zip(later.tolist(), first.tolist())) == [(2, 0), (3, 1), (5, 0)]


def test_substring_sql(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(60)), "en", "s") for i in range(12)]
    make(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, substring_dedup.op5_substring_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(substring_dedup.ORACLE).fetchall())


def test_substring_slots_follow_the_bytes(spark, tmp_path, monkeypatch):
    assert [substring_dedup.slots_of(n << 20) for n in (0, 1 << 20, (1 << 20) + 1, 100 << 20, 1 << 30)] == [1 << 16, 1 << 16, 1 << 17, 1 << 23, 1 << 23]
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3, 80)), "en", "s") for i in range(40)]
    rows += [(50 + i, rows[i % 7][1], "en", "s") for i in range(9)]
    make(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(substring_dedup.ORACLE).fetchall())
    keyed = spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("doc_id as key", "xxhash64(text) as uid", "text")
    monkeypatch.setattr(substring_dedup, "SLOTS", 4)
    for slot_bytes, most, slots in ((1 << 20, 64, 4), (1000, 64, 16), (10, 64, 64)):
        monkeypatch.setattr(substring_dedup, "SLOT_BYTES", slot_bytes)
        monkeypatch.setattr(substring_dedup, "MOST_SLOTS", most)
        first, ways = substring_dedup.deal(keyed, 20, 3)
        assert len(first) == len(ways) == slots
        assert sorted(map(tuple, substring_dedup.op5_substring_dedup(spark, str(tmp_path)).collect())) == want


def test_substring_common_line(spark, tmp_path, monkeypatch):
    """A line that many documents have between different neighbours fills no bucket."""
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"n{x}" for x in rng.integers(0, 10**6, n))
    line, tail = " ".join(f"line{x}" for x in range(10)), fresh(15)
    rows = [(i, f"{fresh(18)} {line} {tail if i % 3 == 0 else fresh(18)}", "en", "s") for i in range(1500)]
    docs = make(spark, rows).repartition(8)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 17)
    keyed = docs.selectExpr("doc_id as key", "xxhash64(text) as uid", "text")
    held = [r.held for r in substring_dedup.packed_windows(keyed).groupBy("bucket").agg(F.sum("text_size").alias("held")).collect()]
    assert max(held) <= 2 * substring_dedup.BUCKET_BYTES
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, substring_dedup.op5_substring_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(substring_dedup.ORACLE).fetchall())


def test_encoder_and_trees():
    import random

    enc, lib, rng = encoder.Encoder(BPE), Tokenizer.from_file(BPE), random.Random(2)
    bits = ["'s", " it's ", "  ", "\n", "é", "中文", "x1", "...", "\x1c", " ", "\x85", "the", "<|endoftext|>", "“q”", "\t \n", "Ж", "½", "×"]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        assert np.frombuffer(enc.ids(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
    for _ in range(60):
        t = "".join(rng.choice(bits[:12] + ["word "] * 20) for _ in range(rng.randrange(200)))
        tree = token_counts.build(enc, t)
        for _ in range(6):
            a = rng.randrange(len(t) + 2)
            tree, t, _n = token_counts.edit(enc, tree, t, a, a + rng.choice([0, 1, 5, 80]), "".join(rng.choice(bits) for _ in range(rng.randrange(4))))
            tree = token_counts.Tree.load(tree.dump())
            assert (tree.chars, tree.tokens) == (len(t), len(lib.encode(t, add_special_tokens=False).ids))
    long = "some words here " * 2000
    assert token_counts.edit(enc, token_counts.build(enc, long), long, 9000, 9004, "new")[2] < 1000


def test_edits_table(spark, docs, empty):
    edits = spark.createDataFrame([(1, 2, 0, 3, "abc"), (1, 1, 5, None, None), (300, 1, 0, 9, "hello"), (3, 1, None, 1, "x")], "doc_id long, seq int, start int, stop int, replacement string")
    out = token_counts.apply_edits(token_counts.attach(token_counts.build_trees(docs, BPE), edits), BPE).collect()
    lib = Tokenizer.from_file(BPE)
    assert len(out) == docs.count()
    assert all(r.n_tokens == len(lib.encode(r.text, add_special_tokens=False).ids) for r in out)
    assert [r.text for r in out if r.doc_id == 300] == ["hello"]
    assert token_counts.build_trees(empty, BPE).count() == 0


def test_token_output(spark, docs, rows, empty):
    lib = Tokenizer.from_file(BPE)
    ids = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    path = f"{token_output.new_path(spark, 'test')}"
    token_output.write_tokens(docs, path, BPE, shard_bytes=2000)
    got = token_output.read_tokens(spark, path).orderBy("task", "shard", "offset").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((r[0], ids(r[1]).tobytes()) for r in rows)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    found = token_output.lookup(spark, path, [5, 7, 301, 99_999]).collect()
    text = {r[0]: r[1] for r in rows}
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter([(5, ids(text[5]).tobytes()), (7, ids(text[7]).tobytes()), (7, ids(text[7]).tobytes()), (301, ids("").tobytes())])
    assert token_output.open_shards(spark, path).count() > 5
    assert token_output.holding(spark, path, [301]).count() == 1 and token_output.holding(spark, path, []).count() == 0
    out = sorted(token_output.token_digests(docs, BPE).collect(), key=lambda r: r.start)
    at, want = 0, Counter((r[0], len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    order = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert order == sorted(order)
    assert token_output.token_digests(empty, BPE).count() == 0


def test_long_texts_are_encoded_in_pieces(monkeypatch, rows):
    enc, lib = encoder.Encoder(BPE), Tokenizer.from_file(BPE)
    monkeypatch.setattr(encoder, "PIECE", 500)
    texts = [r[1] for r in rows if r[1]] + ["it's  \n x" * 400 + "中 文" + " and so on" * 200, "x" * 3000, "<|endoftext|> a b" * 100]
    at = 0
    for part, made in enc.encoded(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]), "text"):
        for i in range(len(part)):
            assert made.ids[made.at[i] : made.at[i + 1]].tolist() == lib.encode(texts[at], add_special_tokens=False).ids
            at += 1
    assert at == len(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    shard = token_output.Shard(token_output.pack(2, keys, np.arange(n) % 3))
    assert shard.find(keys).tolist() == list(range(n))
    assert all(shard.documents(int(k)) == [i] for i, k in enumerate(keys))
    assert (shard.find(np.arange(50)) == -1).all()
    assert n == 0 or sorted(shard.slots.tolist()) == list(range(n))


def test_mixing(docs, rows, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(docs, fan=4).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size) for r in got) == sorted((r[0] if r[0] is not None else -1, len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    share, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        share |= {s: 2.0 * sizes[s] for s in over} if over else {s: weight[s] * unit for s in free}
        left -= sum(share[s] for s in over)
        free -= over or set(free)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, share[r.source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - share[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), fan=4).collect()))
    taken = mixing.mixed(docs, fan=4)
    assert taken.columns == docs.columns and taken.filter("key <> 4 or row <> 'y' or _id <> 2").count() == 0
    assert taken.count() == sum(r.copies for r in got)


def test_pivotal_is_unbiased():
    rng = np.random.default_rng(1)
    size, mass = np.array([5, 3, 8, 2]), np.array([2.0, 1.5, 3.0, 1.0])
    total = np.zeros(4)
    for _ in range(4000):
        out, held = mixing.pivotal(size, mass, rng.random(4))
        assert abs(out.sum() - mass.sum()) < 1e-6
        assert all(i == held or out[i] in (0, size[i]) for i in range(4))
        total += out
    assert np.allclose(total / 4000, mass, atol=0.25)


def test_pivotal_leaves_a_small_document():
    rng = np.random.default_rng(2)
    left, total = [], []
    for _ in range(200):
        size = rng.integers(1, 2000, 50)
        mass, draws = size * rng.uniform(0.05, 0.95), rng.random(50)
        out, held = mixing.pivotal(size, mass, draws)
        if held >= 0:
            out, held = mixing.exchange(size, out, draws, held)
        assert abs(out.sum() - mass.sum()) < 1e-4
        left.append(int(size[held]) if held >= 0 else 0)
        total.append(size.sum())
        assert held < 0 or all(out[i] in (0, size[i]) for i in range(50) if i != held)
    assert np.median(left) < 100 and np.max(np.array(left) / np.array(total)) < 0.01


def test_decontamination(spark, empty):
    rng = np.random.default_rng(8)
    item = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (25, 40, 3, 18)]
    bench = spark.createDataFrame([*enumerate(item), (9, None), (10, "")], "item_id long, text string")
    noise = lambda n: " ".join(f"n{x}" for x in rng.integers(0, 500, n))
    near = item[1].split()
    near[0] = "changed"
    far = item[1].split()
    far[5], far[15], far[25] = "x", "y", "z"
    texts = [noise(50), noise(20) + " " + item[0].upper() + ", " + noise(9), noise(8) + "\n" + " ".join(near), " ".join(far), item[2], "a " + item[2] + " b", item[0] + " " + item[3], None, ""]
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = {0: [], 1: [0], 2: [1], 3: [], 4: [2], 5: [2], 6: [0, 3], 7: [], 8: []}
    for at_once in (5000, 2):
        got = {r.doc_id: sorted(m.item_id for m in r.matches) for r in decontaminate.benchmark_matches(docs, bench, at_once).collect()}
        assert got == want
    assert all(sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench, n).collect()) == [0, 3, 7, 8] for n in (5000, 2))
    assert decontaminate.benchmark_matches(empty, bench).count() == 0
    assert decontaminate.benchmark_matches(docs, bench.limit(0)).count() == len(texts)


def test_decontamination_recall(spark):
    """Edited copies at similarities around the limit, against all windows of all documents."""
    rng = np.random.default_rng(11)
    item = [" ".join(f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(30, 120)))) for _ in range(25)]
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 4000, n)]
    texts = []
    for t in item:
        for edits in (0, 1, 2, 3, 4):
            w = t.split()
            for spot in rng.integers(0, len(w), edits):
                w[spot] = f"e{spot}"
            texts.append(" ".join(noise(12) + w + noise(9)))
    docs, bench = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), spark.createDataFrame([*enumerate(item)], "item_id long, text string")
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    having = Counter(s for t in item for s in shingles(t.split()))
    weigh = lambda bag: sum(c * math.log(1 + len(item) / having.get(s, 1)) for s, c in bag.items())
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i, own in enumerate(item):
            mine, n = shingles(own.split()), len(own.split())
            if not set(mine) & set(shingles(w)):
                continue
            best = max((weigh(mine & bag) / weigh(mine | bag) for bag in (shingles(w[a : a + n]) for a in range(len(w) - n + 1))), default=0)
            if best >= decontaminate.SIMILARITY:
                want[d, i] = best
    got = {(r.doc_id, m.item_id): m.similarity for r in decontaminate.benchmark_matches(docs, bench).collect() for m in r.matches}
    assert sum(0.8 <= v < 0.9 for v in want.values()) >= 15
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and all(math.isclose(got[k], want[k]) for k in got)


def test_decontamination_in_small_steps(spark, monkeypatch):
    """Bounds on what is in hand at once change no result."""
    text = " ".join(["a b c d e f"] * 60)
    docs = make(spark, [(1, text + " g h i", "en", "s"), (2, "x " + text, "en", "s")])
    bench = spark.createDataFrame([(1, text[:200]), (2, "a b c d e f a b c d e f a b"), (3, "b c d e f a")], "item_id long, text string")
    run = lambda: sorted(map(str, decontaminate.benchmark_matches(docs, bench).collect()))
    want = run()
    items = decontaminate.Items([1, 2, 3], [text[:200], "a b c d e f a b c d e f a b", "b c d e f a"])
    words = decontaminate.plain_words(pa.array([text]))
    found = {k: [i for i in range(len(words) - 4)] for k in range(3)}
    match = lambda: items.matches(words.hashes(), found, lambda i, j: b" ".join(text.encode().split()[i:j]))
    whole = match()
    for pairs, span in ((1 << 18, 1 << 14), (7, 5)):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        monkeypatch.setattr(decontaminate, "SPAN", span)
        assert match() == whole and len(whole) == 3
        got = [np.concatenate(x).tolist() for x in zip(*items.candidates(14, [1], found, len(words)))]
        assert got[1] == list(range(len(words) - 13))
    assert want == run() and "item_id=1" in want[0]


def test_decontamination_blocks(spark):
    """Items that share phrases, in one block and in many."""
    rng = np.random.default_rng(18)
    phrase = [" ".join(f"p{x}" for x in rng.integers(0, 300, 8)) for _ in range(4)]
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    item = [f"{fresh(14)} {phrase[i % 4]} {fresh(6)} {phrase[(i + 1) % 4]}" for i in range(12)]
    texts = []
    for i, t in enumerate(item):
        for spot in (0, 7, 16, 25, 33):
            w = t.split()
            w[spot] = "changed"
            texts.append(f"{fresh(5)} {' '.join(w)} {phrase[i % 4]}")
        texts.append(t.replace(phrase[i % 4], phrase[(i + 2) % 4]))  # another item's phrase
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate([*texts, texts[0]])])
    bench = spark.createDataFrame([*enumerate(item), (0, item[0].upper()), (50, None), (51, " . ")], "item_id long, text string")
    got = [sorted(map(str, decontaminate.benchmark_matches(docs, bench, n).collect())) for n in (5000, 5, 2)]
    assert any("item_id" in r for r in got[0]) and got[0] == got[1] == got[2]


def test_quality_by_brute_force(spark):
    """Scores against Gaussian log-densities with explicit covariances, their inverses and determinants."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.quality_scores(docs, labels).collect()}
    rows = docs.select("doc_id", "text").toPandas()
    x = quality.statistics(pa.array(rows["text"].tolist(), pa.string()))
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]])
    label = np.array([i % 3 % 2 if i < 200 else -1 for i in rows["doc_id"]])
    use = [x[~held & (label == k)] for k in (0, 1)]
    n = sum(map(len, use))
    centred = [u - u.mean(0) for u in use]
    pooled = sum(c.T @ c for c in centred) / n
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    value = []
    for k in (0, 1):
        cov = ((1 - quality.POOL) * centred[k].T @ centred[k] / len(use[k]) + quality.POOL * pooled) / np.outer(scale, scale)
        cov = (1 - quality.RIDGE) * cov + quality.RIDGE * np.trace(cov) / len(cov) * np.eye(len(cov))
        off = (x - use[k].mean(0)) / scale
        value.append(np.log(len(use[k]) / n) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    want = 1 / (1 + np.exp(value[0] - value[1]))
    for i, h, s in zip(rows["doc_id"], held, want):
        assert got[i][0] == h and math.isclose(got[i][1], s, abs_tol=1e-6) and got[i][2] == (got[i][1] >= 0.3)


def test_statistics_of_a_text():
    text = "The cat. THE CAT!\nfree | money $$$ a\n\nThe cat."
    words, lines = text.split(), text.split("\n")
    got = dict(zip(quality.NAMES, quality.statistics(pa.array([text]))[0]))
    share = lambda k, n: math.asin(math.sqrt(k / n))
    assert math.isclose(got["bytes"], math.log1p(len(text))) and math.isclose(got["words"], math.log1p(len(words)))
    assert math.isclose(got["unique_words"], share(len(set(words)), len(words))) and math.isclose(got["unique_bigrams"], share(len(set(zip(words, words[1:]))), len(words) - 1))
    assert math.isclose(got["upper"], share(sum(c.isupper() for c in text), len(text))) and math.isclose(got["bar"], share(1, len(text)))
    assert math.isclose(got["mean_word"], math.log1p(np.mean([len(w) for w in words]))) and math.isclose(got["lines"], math.log1p(len(lines)))
    assert math.isclose(got["entropy"], -sum(c / len(text) * math.log(c / len(text)) for c in Counter(text).values()))


def test_long_texts_in_pieces(monkeypatch, rows):
    """Word hashes, statistics and languages are the same however small the pieces of a text are, one long word included."""
    texts = pa.array([t for _, t, _, _ in rows[:70]] + ["x" * 5000 + " and the " + "ab" * 3000, None])
    model = language.train(["the and of that with for " * 9, "der die das und nicht mit " * 9], ["en", "de"])

    def all_of_it():
        w = textops.Words(*textops.column_bytes(texts))
        return w.hashes(), w.joined()[0], quality.statistics(texts), language._scores(texts, model)

    want = all_of_it()
    spans = textops.Spans(textops.column_bytes(texts)[0].astype(np.uint64) + np.uint64(1), "byte")
    w = textops.Words(*textops.column_bytes(texts))
    assert np.array_equal(want[0], spans.hash(w.start, w.end))
    assert want[1] == b" ".join(x.encode() for t in texts.to_pylist() for x in words(t))
    for name, value in (("PIECE_BYTES", 50), ("NUMBERS", 128), ("BLOCK", 7), ("LONG", 100)):
        for module in (textops, quality, language):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    got = all_of_it()
    assert np.array_equal(want[0], got[0]) and want[1] == got[1] and np.allclose(want[2], got[2])
    assert want[3][0] == got[3][0] and np.allclose(want[3][1], got[3][1]) and np.allclose(want[3][2], got[3][2])


def test_quality(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(table, labels)
    assert got.count() == table.count()
    held = got.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert got.filter("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0
    none = labels.limit(0)
    assert quality.quality_scores(docs, none).filter("score = 0.5").count() == docs.count()
    assert quality.quality_scores(empty, none).count() == 0


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a>m</a></nav><div class='ad'>x</div><article><h1>A &amp; B</h1><p><b>c<br><p>d&nbsp; e<script>'</p>'</script><div id=comments>no</div></article><footer>f"
    assert html_text.main_text(page) == "A & B c d e"
    assert html_text.main_text("") == "" and html_text.main_text("plain < text") == "plain < text"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_style_tree(spark):
    pages = [(i, "https://a.example/x", f"<body><div><p>site wide line</p></div><div class=c><p>own words {i} {i * 7}</p></div></body>") for i in range(20)]
    pages += [(90, None, None), (91, "bad url", ""), (92, "http://b.example", "<body><p>only</p></body>"), (0, *pages[0][1:])]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = Counter((r.page_id, r.text) for r in got)
    assert texts[0, "own words 0 0"] == 2 and texts[5, "own words 5 35"] == 1
    assert texts[90, ""] == texts[91, ""] == texts[92, "only"] == 1


def test_html_wrappers_and_teasers():
    body = "long real body " * 20
    for name in ("content with-sidebar", "layout has-sidebar", "post no-comments", "wrap nav-open", "main-content", "header"):
        assert html_text.main_text(f"<div class='{name}'><article>{body}</article></div><div class='ad'>x y</div>") == body.strip()
    assert html_text.main_text(f"<div class='content'>{body}</div><article>a teaser</article>") == f"{body.strip()} a teaser"
    assert html_text.main_text(f"<div id='sidebar'>{body}</div><p>b</p>") == f"{body.strip()} b"  # most of the text is no side bar
    page = f"<article>{body}<div class='comment-list'>c</div><div id=reader-comments>d</div></article><div class='cookie-notice'>n</div><div class='top-banner2'>o</div>"
    assert html_text.main_text(page) == body.strip()


def brute_importance(pages):
    """Composite importance by the definition, over parsed pages of one host."""
    kids, texts, parent, kinds = {}, {}, {}, {}
    for k, page in enumerate(pages):
        for e in html_text.parse(page)[1][1:]:
            if not e.noise:
                parent[e.node] = e.parent.block.node
                texts.setdefault(e.node, {}).setdefault(k, set()).update(e.texts)
                kinds.setdefault(e.node, {}).setdefault(k, set())
                if e.kinds:
                    kinds[e.node][k].add(tuple(dict.fromkeys(e.kinds)))
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)

    def value(n):
        m = len(texts[n])
        if m == 1:
            return 1.0
        log = lambda x: math.log(x, m)
        seen = Counter(t for own in texts[n].values() for t in own)
        ways = Counter(w for own in kinds[n].values() for w in own)
        content = 1 - sum(c * log(c) for c in seen.values()) / sum(seen.values()) if seen else None
        style = log(sum(ways.values())) - sum(c * log(c) for c in ways.values()) / sum(ways.values()) if ways else 0.0
        below = kids.get(n, [])
        if not below:
            return style if content is None else content
        mean = sum(len(texts[c]) * value(c) for c in below) / sum(len(texts[c]) for c in below)
        mean = mean if content is None else (mean + content) / 2
        g = html_text.GAMMA ** len(ways)
        return (1 - g) * style + g * mean

    return {n: value(n) for n in parent if len(texts[n]) > 1}


def test_style_tree_alone(spark):
    """Neutral markup: what repeats over the site goes, what is a page's own stays; against brute force."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 8))
    own = [" ".join(word() for _ in range(30)) for _ in range(9)]
    html = [f"<body><div class=a><ul><li>Start<li>News<li>Contact<li>Page {k} of 9</ul></div><div class=b><p>{t[:90]}</p><p>{t[90:]}</p>{'<ul><li>' + word() + '</ul>' if k % 2 else ''}</div><section><p>All rights</p><div class={word()}>{k}</div></section></body>" for k, t in enumerate(own)]
    pages = spark.createDataFrame([(k, "http://site.example/p", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.node: r.importance for r in html_text.style_tree(html_text.with_host(pages)).collect()}
    want = brute_importance(html)
    assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], abs_tol=1e-9) for n in want)
    texts = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(texts[k].startswith(" ".join(t[:90].split())) and "News" not in texts[k] and "rights" not in texts[k] for k, t in enumerate(own))
    plain = {k: html_text.main_text(h) for k, h in enumerate(html)}
    assert all("News" in plain[k] and "rights" in plain[k] for k in plain)


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(table, 60)
    got = language.languages(table, model).join(table, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    out = {r.doc_id: r for r in language.languages(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (300, 301, 302, 303))
    assert language.languages(empty).count() == 0
    mixed = make(spark, [(1, "the and of that with for and the of is was by zukeit nicht und der die das mit sich von den", "en", "s")])
    labels = language.label_words(mixed, model).first()
    assert labels.langs[2] == "en" and labels.langs[-2] == "de"
    assert language.in_language(docs).columns == docs.columns
    assert labels.words[2] == "of" and language.letter_words(pa.array(["\u0301a\u0301b c\u0301 1\u0301"])).first.tolist() == [0, 2]


def test_in_language_rejects_what_was_not_learned(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(6)
    junk = " ".join("".join(rng.choice(list("xqzjkvw"), 6)) for _ in range(60))
    foreign = " ".join("".join(rng.choice(list("абвгдежзиклмн"), 5)) for _ in range(60))
    planted = spark.createDataFrame([(10**9 + i, t, None, "s", 0) for i, t in enumerate((junk, foreign, "12345 !!", None))], table.schema)
    kept = {r.doc_id for r in language.in_language(table.unionByName(planted)).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(4)} and len(kept) >= 0.999 * table.count()


def test_language_sample_is_the_same_over_any_partitions(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    repeated = table.unionByName(table.limit(1).crossJoin(spark.range(50)).drop("id"))
    a, b = (language.fit(repeated.repartition(n), 20) for n in (1, 5))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.lexicon, b.lexicon)


def test_forward_backward(monkeypatch):
    rng = np.random.default_rng(0)
    emission, transition, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    begins = np.zeros(7, bool)
    begins[[0, 4]] = True
    want = np.zeros((7, 3))
    for lo, hi in ((0, 4), (4, 7)):
        for y in itertools.product(range(3), repeat=hi - lo):
            p = np.exp(start[y[0]] + sum(emission[lo + i, y[i]] for i in range(hi - lo)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            for i, k in enumerate(y):
                want[lo + i, k] += p
    want /= want.sum(1, keepdims=True)
    for long, step in ((language.LONG, language.STEP), (2, language.STEP), (2, 2)):
        monkeypatch.setattr(language, "LONG", long)
        monkeypatch.setattr(language, "STEP", step)
        for numbers in (language.NUMBERS, 1):
            monkeypatch.setattr(language, "NUMBERS", numbers)
            alpha, beta = language.forward_backward(emission, begins, start, transition)
            assert np.allclose(want, alpha * beta / (alpha * beta).sum(1, keepdims=True))
        monkeypatch.undo()


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < kept.count()
    final = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert len(final) == kept.count()
