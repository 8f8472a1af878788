"""Operators over small awkward tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns whose names clash with those that the operators make."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from zephyra.llm import archives, bpe, decontaminate, langid, neardup, repeats, sharding, tokencount, topk, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, score double, row string, n int"


def _documents():
    rng = random.Random(12)
    word = {
        "en": ["the", "of", "and", "thing", "house", "water", "river", "stone"],
        "de": ["der", "und", "schön", "straße", "wasser", "fluss", "über", "haus"],
    }
    shared = " ".join(rng.choice(word["en"]) + str(i) for i in range(60))
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(word[lang]) + rng.choice(["", "s", str(rng.randint(0, 99))]) for _ in range(rng.randint(1, 120)))
        if i % 5 == 0:
            text += " " + shared
        rows.append((i, text, lang, f"src{i % 4 if i % 2 else 0}"))
    near = rows[7][1].split()
    rows += [(100 + k, " ".join([*near[:k], "new", *near[k + 1 :]]), "en", "src0") for k in range(0, 12, 3)]
    rows += [(200, rows[5][1], "en", None), (200, rows[5][1], "en", None), (201, None, "en", "src1"), (202, "", None, "src1")]
    rows += [(None, rows[10][1], None, "src0"), (203, "... 123 !!", "de", "src0"), (204, " \n\t ", "en", "src0"), (205, "É", "de", "src0")]
    rows += [(206, "x" * 30_000, "en", "src2"), (207, ("ab " * 20_000) + shared, "en", "src2"), (208, "short", "en", "src0"), (209, "short", "en", "src0")]
    return [(*r, len(r[1] or ""), 1, 2.0, "r", 3) for r in rows]


ROWS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------ shards


def test_shards(docs, none):
    got = sharding.shards(docs, n_shards=7, rows_per_bucket=5).collect()
    want = []
    by_source = defaultdict(list)
    for doc_id, text, _, source, *_ in ROWS:
        digest = hashlib.md5(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        by_source[source].append((digest, -1 if doc_id is None else doc_id, (text or "").encode()))
    for rows in by_source.values():
        want += [((2 * k + 1) / (2 * len(rows)), *row) for k, row in enumerate(sorted(rows))]
    expected = []
    for k, (_, _, doc_id, text) in enumerate(sorted(want)):
        shard = ((k + 1) * 7 - 1) // len(want)
        expected.append((None if doc_id < 0 else doc_id, len(text) + 16, zlib.crc32(text), "rows", shard, k - shard * len(want) // 7, None))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert max(Counter(r["shard"] for r in got).values()) - min(Counter(r["shard"] for r in got).values()) <= 1
    assert sharding.shards(none).count() == 0


# ------------------------------------------------------------------ language, tokens, toxicity


def test_language(docs, none):
    got = {(r["doc_id"], r["lang_pred"], r["held_out"]): r["score"] for r in langid.identify(docs, PIECES).collect()}
    assert {(i, "und", zlib.crc32(str(i).encode()) % 3 == 1) for i in (201, 202, 203, 204)} <= set(got)
    right = [lang == p for i, text, lang, *_ in ROWS[:60] for j, p, _ in got if i == j and len(text) > 40]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= s <= 1 for s in got.values()) and len(langid.identify(docs, PIECES).collect()) == len(ROWS)
    assert langid.identify(none, PIECES).count() == 0
    unlearned = langid.identify(docs.withColumn("lang", docs["lang"].substr(99, 1)).replace("", None, ["lang"]), PIECES)
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}


def test_language_model_does_not_depend_on_partitions(docs):
    one, two = (langid.fit(langid.training_rows(d), PIECES) for d in (docs.coalesce(1), docs.repartition(5)))
    assert one.languages == two.languages and np.allclose(one.theta, two.theta)


def test_token_counts(docs, none):
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, PIECES).collect()}
    assert (got[201]["n_bytes"], got[201]["n_words"], got[201]["n_tokens"]) == (0, 0, 0)
    assert got[204]["n_tokens"] == 0 and got[206]["n_words"] == 1 and got[205]["n_words"] == 1
    assert got[5]["n_tokens"] == got[200]["n_tokens"] > got[5]["n_words"]
    assert tokencount.count_tokens(none, PIECES).count() == 0


def test_byte_bpe(docs, none):
    tokens = bpe.load_ranks(RANKS)
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in ROWS:
        ids = library.encode_ordinary(text or "")
        digests = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        want.append((doc_id, len(ids), *digests, ids))
    made = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, batch_bytes=20_000, buckets=3)
    assert rows_of(made, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == sorted(want, key=repr)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    blank = docs.where("text is null or text = ''")
    assert [r["n_tokens"] for r in bpe.encode(blank, RANKS, public_tokenizers.PATTERN).collect()] == [0, 0]


def test_toxicity_learns_a_pair_that_no_single_term_shows(spark, none):
    rng = random.Random(3)
    plain = ["stone", "river", "house", "water", "green", "field"]
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = rng.sample(plain, 2) + ["insult"] * a + ["group"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text), None, None, 0, 0, 0.0, "", 0))
        labels.append((i, int(a and b), 7))
    labels += [(5000, 1, 7), (None, 1, 7), (3, None, 7)]
    docs = spark.createDataFrame([*rows, (9000, None, *rows[0][2:]), (9001, "", *rows[0][2:])], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    got = toxicity.toxicity(docs, known).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1200]
    truth = {i: t for i, t, _ in labels if i is not None and t is not None}
    assert sum(r["predicted"] == truth.get(r["doc_id"], 0) for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, known).count() == 0
    half = toxicity.toxicity(docs, known.where("false"))
    assert {r["score"] for r in half.collect()} == {0.5}


# ------------------------------------------------------------------ copies


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(rows):
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)].append(row[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("crowded", "block"), [(20, 4096), (1, 2)])
def test_near_duplicates(docs, crowded, block):
    made = neardup.near_duplicates(docs, crowded=crowded, block=block)
    assert rows_of(made, "doc_id", "n_shingles", "component_id") == sorted(_components(ROWS), key=repr)


def test_near_duplicates_of_chains_and_of_nothing(spark, none):
    words = [f"w{i}" for i in range(60)]
    chain = [(k, " ".join([f"v{k}_{i}" if i < 2 * k else w for i, w in enumerate(words)])) for k in range(12)]
    chain += [(50 + k, " ".join([*words[:30], f"x{k}", *words[31:]])) for k in range(30)]
    chained = spark.createDataFrame(chain, "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(chained), "doc_id", "n_shingles", "component_id") == sorted(_components(chain), key=repr)
    assert neardup.near_duplicates(none).count() == 0


def _kept(rows):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    owner = {}
    order = float("inf")
    for doc_id, data in raw:
        for i in range(len(data) - 49):
            w = data[i : i + 50]
            owner[w] = min(owner.get(w, order), order if doc_id is None else doc_id)
    out = []
    for doc_id, data in raw:
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if owner[data[i : i + 50]] < (order if doc_id is None else doc_id):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("crowded", "busy"), [(50_000, 64), (1, 64), (50_000, 1)])
def test_repeated_stretches(docs, crowded, busy):
    made = repeats.removed(docs, crowded=crowded, busy=busy)
    assert rows_of(made, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(_kept(ROWS), key=repr)


def test_repeated_stretches_of_two_texts_under_one_id(spark, none):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, "before " + long), (2, long + " after"), (2, long + " after"), (3, "z" * 49), (4, "z" * 49), (5, "y" * 200), (6, "y" * 51)]
    made = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(made, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(_kept(rows), key=repr)
    assert repeats.removed(none).count() == 0


# ------------------------------------------------------------------ benchmark passages


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _contaminated(rows, items):
    out = []
    for row in rows:
        words, hit, found = _words(row[1]), set(), set()
        for item_id, text in items:
            own = _words(text)
            n = min(13, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item_id or ""))
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((row[0], len(words), len(hit), len(found), names, bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize(("block_words", "shard_words"), [(500_000, 4_000_000), (40, 300)])
def test_contamination(spark, docs, none, block_words, shard_words):
    passage = next(r[1] for r in ROWS if r[0] == 0)
    items = [(2, passage), (10, " ".join(passage.split()[:9]).upper()), (3, "short"), (4, None), (5, ""), (6, "ab ab ab"), (6, "ab ab ab"), (7, "É")]
    items += [(8, " ".join(ROWS[12][1].split()[3:30])), (None, "house")]
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    made = decontaminate.contamination(docs, benchmark, block_words=block_words, shard_words=shard_words)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows_of(made, *columns) == sorted(_contaminated(ROWS, items), key=repr)
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    for row in made.where("n_hit > 0").collect():
        spans = [text[row["doc_id"]][a:b] for a, b in zip(row["span_starts"], row["span_ends"], strict=True)]
        assert sum(len(_words(s.decode())) for s in spans) == row["n_hit"]
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert {r["contaminated"] for r in decontaminate.contamination(docs, benchmark.where("false")).collect()} == {False}


# ------------------------------------------------------------------ search


@pytest.mark.parametrize(("shard_rows", "query_block"), [(1 << 16, 4096), (37, 2)])
def test_top_k(spark, shard_rows, query_block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)], 1) for i in range(400)]
    rows += [(500 + i, rows[0][1], 1) for i in range(15)] + [(900, None, 1), (1000, [1.0, None, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 5, 1)]
    rows += [(1200, [float("inf")] * 5, 1), (1300, [1.0, 2.0], 1), (1400, [0.5, 1.0], 1), (None, [1.0] * 5, 1), (1500, [], 1), (400, rows[1][1], 1), (400, rows[1][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(whole):
        if q % 100 == 0:
            best = sorted((-int(whole[c] @ whole[q]), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    made = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), shard_rows=shard_rows, query_block=query_block)
    assert rows_of(made, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(vectors.where("false"), vectors).count() == 0
    assert topk.top_k(vectors, vectors.where("false")).count() == 0


# ------------------------------------------------------------------ archives


def test_archives(spark):
    page = "<html>" + "é" * 100
    rows = [(i, f"http://a/{i} b", page if i % 3 == 0 else f"{page}{i}", 1) for i in range(3, 20)]
    rows += [(30, None, None, 1), (31, "", "", 1), (32, "http://x", "short", 1), (33, "http://x", "short", 1), (34, "u", "\r\n\r\nWARC/1.1\n" * 20, 1)]
    rows += [(40, "v", page + "!", 1), (40, "v", page + "!", 1), (None, "w", page, 1), (50, "long", "z" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(4)
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and html in first and i != first[html]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(archives.archive(pages), *columns) == sorted(want, key=repr)
    assert archives.archive(pages.where("false")).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_one_after_another(spark, docs, tmp_path):
    columns = "doc_id", "text", "lang", "source", "n_chars"
    items = spark.createDataFrame([(1, ROWS[12][1])], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    rows, now = [r[:5] for r in ROWS], docs.select(*columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), now.schema)
        assert now.columns == list(columns)
        if name == "language_id":
            rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
        elif name == "near_duplicates":
            kept = [r for r, (i, _, c) in zip(rows, _components(rows), strict=True) if i is None or i == c]
            rows = list(dict.fromkeys(kept))
        elif name == "suffix_dedup":
            assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in now.select("doc_id", "text").collect() if i is not None) == sorted(
                (i, d) for i, *_, d in _kept(rows) if i is not None
            )
            rows = [tuple(r) for r in now.collect()]
            assert all(r[4] == len(r[1]) for r in rows if r[0] != 206)
        else:
            rows = [r for r, c in zip(rows, _contaminated(rows, [(1, ROWS[12][1])]), strict=True) if not c[-1]]
        assert sorted(map(tuple, now.collect()), key=repr) == sorted(rows, key=repr)
    last = corpus_pipeline.run(spark, str(tmp_path))
    want = sorted((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in rows if r[0] is not None)
    assert sorted((i, d) for i, d in last.select("doc_id", "decoded_sha256").collect() if i is not None) == want
