"""Each operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.llm import decontaminate, embeddings, language_id, licenses, minhash, pii, source_mix, substrings, token_counts, warc
from hornlake.llm.components import components
from hornlake.llm.shared import hash_sample

_A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+").findall, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, spans string, items string, id long, taken string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts, ids=None):
    """Documents with further columns whose names clash with those that operators add."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, 7, 1, 0.5, "x", "y", 99, "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Été", "Über", "İx", "naïve."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 80]))) for _ in range(n)]
    for _ in range(n // 2):
        own = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    shared = " ".join(rng.choice(words) for _ in range(25))
    texts += [f"{rng.choice(words)} {shared} {rng.choice(words)}" for _ in range(4)]
    return [*texts, None, "", "  \n\t", "\x85 x", "a " * 700, "a", "LONE", texts[0], texts[0]]


TEXTS = corpus()
IDS = random.Random(9).sample(range(1000), len(TEXTS))


# 1


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*TEXTS, "it's <|endoftext|> here", "<|endoftext|>", "\x1c\x1d x\xa0y", "՘ᰀ text", "中文 字\n\n  x ", "x" * 3000, "!!!???" * 50, "12 345\t6"]
    library = Tokenizer.from_file(path)
    for cache in (3, 1000):
        rows = token_counts.token_counts(table(spark, texts), path, cache_entries=cache, limit=20).collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r["doc_id"]] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 20)
    assert token_counts.token_counts(table(spark, []), path).count() == 0
    frequent = token_counts.frequent_lengths(table(spark, texts), path, table_entries=40, share=0, least=1)
    counts = {}
    for t in texts:
        for x in token_counts.pre_tokens()(t or ""):
            counts[x] = counts.get(x, 0) + 1
    assert len(frequent) == 40 and sorted(counts[x] for x in frequent) == sorted(counts.values())[-40:]
    assert all(n == len(library.encode(x, add_special_tokens=False).ids) for x, n in frequent.items())
    invented = token_counts.frequent_lengths(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), path, table_entries=2000, least=2)
    assert sum(n > 1 for n in invented.values()) > 100
    assert token_counts.unpacked(token_counts.packed(frequent)) == frequent


def test_sketch_keeps_what_is_frequent():
    rng = random.Random(8)
    sketch, counts = token_counts.Sketch(50), {}
    for _ in range(400):
        items = [f"w{min(int(rng.paretovariate(0.9)), 5000)}" for _ in range(100)]
        sketch.add(items)
        for x in items:
            counts[x] = counts.get(x, 0) + 1
    top = sorted(counts, key=counts.get)[-20:]
    assert len(sketch.counts) <= 100 and set(top) <= set(sketch.counts) and all(sketch.counts[x] <= counts[x] for x in sketch.counts)


def test_pre_tokens_of_stable_characters():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = token_counts.Counter(path, {}, 10_000)
    for c in [*range(1, 0x530), *range(0x2010, 0x205F), *range(0x3000, 0x3100), 0xD7A3, 0xE000, 0x1F600, 0x31350]:
        text = f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)}{chr(c)} x"
        assert counter.count(text) == counter.encoded(text), hex(c)


# 2


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 700
    pages = [(1, "http://a/\r\nX: y", long), (5, None, long), (3, "http://b", long), (4, "http://c", "short"), (6, "http://d", "short"), (7, "u", None), (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n" * 40), (9, "u", "\r\n\r\n"), (None, "n", "no id"), (5, None, long)]
    df = spark.createDataFrame([(*p, "extra", "t") for p in pages], "page_id long, url string, html string, type string, id string")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path, file_bytes=4000)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(pages)
    captures = warc.assemble(records).cache()
    assert captures.count() == len(pages) and captures.filter("n_request = 1 and n_metadata = 1").count() == len(pages)
    assert sorted(bytes(r["p"]).decode() for r in captures.select(F.col("response.payload").alias("p")).filter("p is not null").collect()) == sorted([long, "short", "short", "", pages[6][2], "\r\n\r\n", "no id"])
    rows = warc.page_captures(captures).collect()
    found = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in rows)
    one = hashlib.sha1(long.encode()).hexdigest()
    for i, kind, to, n, digest in found:
        html = next(h or "" for p, _, h in pages if (p if p is not None else -1) == i)
        assert (n, digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert (to == 5) == (kind == "revisit") == (digest == one and not (i == 5 and kind == "response"))
    assert [k for i, k, *_ in found if i == 5] == ["response", "revisit"]
    warc.write_archive(df.limit(0), str(tmp_path / "empty"))
    with pytest.raises(TypeError):
        warc.write_archive(df.withColumn("page_id", F.lit("x")), str(tmp_path / "refused"))
    orphan = records.filter("type <> 'response' or uri <> 'http://c'")
    assert warc.assemble(orphan).filter("response is null and n_request = 1").count() == 1


def test_warc_parser_reads_plain_and_broken():
    import io

    good = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(h["warc-type"], b) for h, b in warc.parse(io.BytesIO(good * 2))] == [("warcinfo", b"abc")] * 2
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"no archive\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(good[:-6])))


# 3


def brute_language(dictionaries, texts):
    """Each text's pieces compressed with one plain dictionary after another."""
    import zstandard as z

    params = z.ZstdCompressionParameters.from_level(3, strategy=z.STRATEGY_LAZY2, min_match=3, window_log=17, hash_log=16, chain_log=16, search_log=4, format=z.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0)
    out = []
    for t in texts:
        raw = " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode()
        pieces = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
        pieces += [raw[i:96] for i in [*range(2, 32, 2), *range(32, 96, 8)] if i < len(raw)]
        sizes = sorted((sum(len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(x)) for x in pieces), lang) for lang, d in dictionaries.items())
        out.append((sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]) if raw else ("und", 0.0))
    return out


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = language_id.fit_dictionaries(docs, ~language_id.held_out())
    assert sorted(dictionaries) == ["de", "en", "es", "fr"]
    rows = language_id.identify(docs.withColumn("held_out", language_id.held_out()).withColumn("score", F.lit("clash")), dictionaries).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    for least, most, share in ((0, 40, 0.8), (40, 100, 0.9), (100, 10**9, 0.97)):
        right = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and least <= len(r["text"]) < most and r["lang"]]
        assert len(right) < 10 or sum(right) / len(right) > share, (least, len(right), sum(right) / len(right))
    plain = brute_language(dictionaries, [r["text"] for r in rows[:150]])
    assert [(r["lang_pred"], r["score"]) for r in rows[:150]] == plain
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = language_id.identify(table(spark, [None, "", "123 !!", "²", "中", "the and", "x" * 100_000]), dictionaries).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, True, False, False, False] and odd[0]["rejected"]
    assert language_id.fit_dictionaries(table(spark, []), F.lit(True)) == {}
    assert {r["lang_pred"] for r in language_id.identify(table(spark, ["some text"]), {}).collect()} == {"und"}


def test_samples_of_groups_with_many_copies(spark):
    """101 distinct texts in 10,000 rows, one in 1,000, and 8,000 in as many."""
    sizes = [("aa", 10_000, 101), ("bb", 1000, 1), ("cc", 8000, 8000)]
    rows = reduce(DataFrame.union, (spark.range(n).select(F.lit(g).alias("lang"), F.concat(F.lit(f"text {g} "), F.col("id") % distinct).alias("text")) for g, n, distinct in sizes))
    found = {r["lang"]: r["count"] for r in hash_sample(rows, "text", 160, "lang").groupBy("lang").count().collect()}
    assert (found["aa"], found["bb"]) == (101, 1) and 200 < found["cc"] < 440
    assert hash_sample(rows.filter("lang = 'aa'"), "text", 160).count() == 101
    assert hash_sample(rows.filter("lang is null"), "text", 160).count() == 0
    headed = rows.select("lang", F.concat(F.lit("header " * 100), "text").alias("text"), F.lit(1).alias("doc_id"))
    assert sorted(language_id.fit_dictionaries(headed, F.lit(True))) == ["aa", "bb", "cc"]


# 4


def brute_vectors(rows, cosine=0.98):
    fine = {}
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[k] = np.array(v, dtype=np.float32).astype(np.float64)
    parent = {k: k for k in fine}
    links = dict.fromkeys(range(len(rows)), 0)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in fine:
        for b in fine:
            if a < b and rows[a][1] == rows[b][1] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= cosine * np.linalg.norm(fine[a]) * np.linalg.norm(fine[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        comp = min(rows[j][0] for j in fine if root(j) == root(k)) if k in fine else i
        out.append((i if i is not None else -1, links[k], comp if comp is not None else -1, i == comp))
    return sorted(out)


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        center = rng.normal(size=16)
        for _ in range(8):
            rows.append((len(rows), int(c % 3), (center + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2, 0.6])).tolist()))
    rows += [(200, 0, None), (201, 0, [0.0] * 16), (202, 0, [None] * 16), (203, 0, [float("nan")] * 16), (204, None, rows[0][2]), (None, 0, rows[0][2]), (205, 0, []), (206, 0, [1.0, 2.0]), (207, 0, [2.0, 4.0]), (208, 0, rows[0][2]), (209, 0, [2 * x for x in rows[0][2]]), (210, 0, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, n int, cnt int")
    found = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1, bool(r[3])) for r in embeddings.near_duplicates(df).collect())
    expected = [(a, b, c, d) for a, b, c, d in brute_vectors([(r[0], r[1], r[2]) for r in rows])]
    assert found == [(a, b, c, d or a == -1) for a, b, c, d in expected]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    blocks = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1, bool(r[3])) for r in embeddings.near_duplicates(df).collect())
    assert blocks == found
    with pytest.raises(TypeError):
        embeddings.near_duplicates(df.withColumn("label", F.lit("x")))


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_filters_find_pairs_at_the_least_cosine(dim):
    """Recall at cosine 0.98 exactly, and how few of the directions a vector looks up, whatever their number."""
    rng = np.random.default_rng(dim)
    x, z = rng.normal(size=(2, 1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    both = np.concatenate([x, 0.98 * x + np.sqrt(1 - 0.98**2) * z])
    for bits in (8, 14, 18) if dim > 16 else (8, 14):
        row, code = embeddings.list_decode(both, bits)
        lists = [set(c.tolist()) for c in np.split(code, np.searchsorted(row, np.arange(1, len(both))))]
        assert np.mean([bool(lists[k] & lists[k + 1500]) for k in range(1500)]) >= 0.99
        assert len(code) / len(both) < 12 and len(code) / len(both) / (embeddings.BOOKS << bits) < 0.01


def test_pairs_of_buckets_count_once(monkeypatch):
    """Small and large buckets against each other and against all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 12)).repeat(30, axis=0) + rng.normal(size=(150, 12)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, code = embeddings.list_decode(x, 6)
    lists = np.split(code, np.searchsorted(row, np.arange(1, len(x))))
    found = {}
    for small in (1, 200):
        monkeypatch.setattr(embeddings, "SMALL", small)
        pairs = []
        for c in np.unique(code):
            who = row[code == c]
            padded = np.array([[*own, *(-1 - 100 * w - np.arange(40 - len(own)))] for w, own in ((w, lists[w].tolist()) for w in who)])
            for i, j in embeddings.near_pairs(x[who], padded, np.full(len(who), c), [(0, len(who))], 0.98):
                pairs += zip(who[i].tolist(), who[j].tolist(), strict=True)
        assert len(pairs) == len(set(pairs))
        found[small] = set(pairs)
    exact = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True)}
    assert found[1] == found[200] <= exact and len(found[1]) >= 0.99 * len(exact) > 100


# 5


def brute_mix(rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(SPACED(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * share > 3 * sizes[s]]
        if not over:
            return sizes, {s: float(capped[s]) if s in capped else weight[s] * share for s in order}
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("case", ["plain", "hot", "tiny", "empty words"])
def test_source_mix(spark, case):
    texts = {"plain": TEXTS, "hot": TEXTS, "tiny": ["a b", "c", None], "empty words": [None, "", " "]}[case]
    df = table(spark, texts)
    if case == "hot":
        df = df.withColumn("source", F.when(F.col("doc_id") % 10 < 8, "big").when(F.col("doc_id") == 9, "one").otherwise(F.col("source")))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    sizes, goals = brute_mix(rows)
    found = {r["doc_id"]: r for r in source_mix.mix(df, slot_bits=10, buckets=8).collect()}
    assert len(found) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for i, t, s in rows:
        r = found[i]
        assert r["size"] == len(SPACED(t or "")) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(goals[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == pytest.approx(goals[s], abs=1) for s in sizes)
    assert {r["doc_id"]: r for r in source_mix.mix(df.repartition(3), slot_bits=10, buckets=5).collect()} == found
    assert source_mix.mix(df.limit(0)).count() == 0


def test_every_prefix_of_the_mix_holds_the_weights(spark):
    """Of the mix's first words, however many, each source has its share, and pieces rebuild what the documents take."""
    rng = random.Random(12)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice(["a", "a", "a", "b", "c"])) for k in range(400)]
    rows += [(5, rows[5][1], "a"), (5, rows[5][1], "a"), (6, "x y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = source_mix.sequence(df, slot_bits=10, buckets=8).collect()
    found = source_mix.mix(df, slot_bits=10, buckets=8).collect()
    target = {r["source_size"]: r["target"] for r in found}
    sizes = {s: sum(len(SPACED(t)) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    share = {s: target[n] / sum(target[m] for m in sizes.values()) for s, n in sizes.items()}
    block = {}
    for p in pieces:
        block[p["source"], p["slot"]] = block.get((p["source"], p["slot"]), 0) + p["words"]
    done, total = dict.fromkeys(sizes, 0), 0
    for p in pieces:
        done[p["source"]] += p["words"]
        total += p["words"]
        # van der Corput points: a discrepancy of a few blocks for each bit of the schedule
        assert all(abs(done[s] - share[s] * total) <= 12 * max(block.values()) for s in sizes)
    taken = {}
    for p in pieces:
        taken[p["doc_id"]] = taken.get(p["doc_id"], 0) + p["words"]
    own = {}
    for r in found:
        own[r["doc_id"]] = own.get(r["doc_id"], 0) + r["taken"]
    assert taken == {k: n for k, n in own.items() if n}
    first = {}
    for p in pieces:
        first.setdefault(p["doc_id"], (p["slot"], p["offset"]))
    assert all((r["first_slot"], r["first_offset"]) == first[r["doc_id"]] for r in found if r["taken"] and r["doc_id"] not in (5, 6))


def test_schedule_spreads_sources(spark):
    goals = spark.createDataFrame([("a", 100, 1, 600.0), ("b", 100, 2, 300.0), (None, 100, 3, 100.0)], "source string, source_size long, weight long, target double")
    rows = source_mix.schedule(goals, slot_bits=10).collect()
    assert sum(r["to_word"] - r["from_word"] for r in rows) == 1000
    first = [r for r in rows if r["slot"] < 100]
    assert abs(sum(r["source"] == "a" for r in first) - 60) <= 3 and abs(sum(r["source"] is None for r in first) - 10) <= 3
    for s in ("a", "b", None):
        own = sorted((r["slot"], r["rank"], r["from_word"], r["to_word"]) for r in rows if r["source"] == s)
        assert [r[1] for r in own] == list(range(len(own))) and all(x[3] == y[2] for x, y in zip(own, own[1:], strict=False))


# 6


def brute_leaks(texts, items, size):
    windows = {}
    for i, t in items:
        w = ALNUM((t or "").translate(_A_Z))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for t in texts:
        w = ALNUM((t or "").translate(_A_Z))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), ",".join(sorted(map(str, names - {None})))))
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice([t for t in TEXTS if t]).split()[:n])) for k, n in enumerate([12, 30, 3, 2, 1, 10, 11, 0, 80])]
    items += [(50, None), (51, ""), (None, items[0][1]), (52, items[1][1]), (7, "a a a")]
    texts = [*TEXTS, (items[0][1] or "").upper() + "!", "x," + items[1][1].replace(" ", "--") + ".y"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(texts, items, 10)
    for block in (8 << 20, 200):
        found = decontaminate.contamination(table(spark, texts), benchmark, block_bytes=block).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found] == expected
        assert all(sum(s["end"] - s["first"] for s in r["hit_spans"]) == r["n_hit"] for r in found)
    clash = table(spark, texts).withColumns({c: F.lit(c) for c in ("text_", "spans_", "items_", "n_words_", "work_0", "Work_2")})
    kept = decontaminate.contamination(clash, benchmark).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], ",".join(r["items"])) for r in kept] == expected
    assert all(r[c] == c for r in kept for c in ("text_", "spans_", "items_", "n_words_", "work_0", "Work_2"))
    empty = decontaminate.contamination(table(spark, TEXTS), benchmark.limit(0)).agg(F.sum("n_hit"), F.sum(F.size("items"))).first()
    assert tuple(empty) == (0, 0)
    assert decontaminate.contamination(table(spark, []), benchmark).count() == 0


# 7


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    texts = [*TEXTS, "Under the MIT License", "under the mit license under the mit license", "apache license, version 2.0; CC-BY NC", mit, "xx " + mit.replace("without restriction", "with joy") + " yy", " ".join(mit.split()[:6]), "under the mit"]
    rows = licenses.scan(table(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        w = ALNUM((t or "").translate(_A_Z))
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    n = len(TEXTS)
    assert [r["labels"] for r in rows[n + 3 : n + 6]] == ["mit", "mit", ""] and all(r["labels"] == "" for r in rows[:n])
    span = rows[n + 4]["spans"][0]
    assert span["first"] == 1 and span["end"] == len(ALNUM(mit)) + 1 and 0.7 < span["share"] < 1
    words = mit.split()
    echo = [" ".join([*words[:30], *words[:5], *words[30:]]), " ".join([*words[:30], *"one two three four".split(), *words[30:]]), " ".join([*words[:10], *words[:10], *words[10:40], *words[5:12], *words[40:]])]
    for r in licenses.scan(table(spark, echo)).collect():
        assert r["labels"] == "mit" and r["score"] > 0.9
    whole = licenses.scan(table(spark, [f"intro {text} outro" for _, text in licenses.TEMPLATES])).orderBy("doc_id").collect()
    assert all(label in r["labels"].split(",") and r["score"] == 1.0 for (label, _), r in zip(licenses.TEMPLATES, whole, strict=True))
    assert licenses.scan(table(spark, [])).count() == 0


def test_chains_are_the_best_ones():
    """Chained words against a search over all ways to chain a few places."""
    from itertools import combinations

    scanner = licenses.Scanner(tuple(licenses.PHRASES.items()), (("x", " ".join(f"w{k}" for k in range(40))),), 4, 8, 0.7)
    rng = random.Random(3)
    for _ in range(200):
        places = sorted({(0, e := rng.randrange(4, 60), min(40, max(4, e + rng.randrange(-6, 7))), rng.choice([4, 5, 8])) for _ in range(6)})
        best = 0
        for n in range(1, len(places) + 1):
            for chain in combinations(sorted(places, key=lambda p: (p[1], p[2])), n):
                covered = chain[0][3]
                for a, b in zip(chain, chain[1:], strict=False):
                    if not (b[2] > a[2] and 0 < b[1] - a[1] <= b[3] + 8):
                        break
                    covered += min(b[3], b[2] - a[2], b[1] - a[1])
                else:
                    best = max(best, covered)
        assert max(round(share * 40) for *_, share in scanner.chains(places)) == best


def test_automaton_gives_matching_statistics():
    rng = random.Random(2)
    for _ in range(40):
        sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        text = [rng.randrange(5) for _ in range(30)]
        auto = licenses.SuffixAutomaton(sequences)
        for i, (state, length) in enumerate(auto.statistics(text), 1):
            best = max(n for n in range(i + 1) if n == 0 or any(text[i - n : i] == s[k : k + n] for s in sequences for k in range(len(s))))
            assert length == best
            if length:
                ends = {(q, k + length) for q, s in enumerate(sequences) for k in range(len(s)) if s[k : k + length] == text[i - length : i]}
                assert auto.ends[state] == ends


# 8

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and bool(d) and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return [(a, b, list(PATTERNS)[k]) for a, k, b in sorted(out)]


def test_base_patterns():
    rng = random.Random(5)
    pieces = ["a@b.co", "@", "x.y+z%1@mail-1.ex.org", "..a@b", "é", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "1" * 25, "+49 (30) 1234-567", "+1", "++49 30 12345678", " ", "-", ".", "7", "\n", "\x0b", "٣", "a@b.c+d@e.f", "@@", "+"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == brute_pii(text), text
    assert pii.base_spans("1" * 200_000 + "@" * 1000) == []


def test_tagger_finds_what_patterns_miss(spark):
    texts = [None, "", "x", "Reach me at (415) 555-2671 or jane.doe@mail.example.org today", "call 415-555-2671 now", "write to bob [at] site [dot] org please", "plain words and a date 2024-01-02, version 1.2.3, price $3,200.50", "é" * 400 + " +49 30 1234567 " + "w " * 300, "a " * 5000]
    docs = table(spark, texts)
    weights = pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = pii.find_pii(docs, weights).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        base = [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]
        assert base == brute_pii(t or "")
    found = [{(t or "")[s["start"] : s["end"]] for s in r["spans"]} for t, r in zip(texts, rows, strict=True)]
    assert "jane.doe@mail.example.org" in found[3] and "+49 30 1234567" in found[7]
    assert found[6] == set() and found[8] == set()
    clean = pii.find_pii(docs, weights, redact=True).orderBy("doc_id").collect()
    assert clean[0]["text"] is None and "[EMAIL]" in clean[3]["text"] and "jane" not in clean[3]["text"] and clean[6]["text"] == texts[6]
    assert pii.find_pii(table(spark, []), weights).count() == 0
    assert pii.redacted("abcdef", [(1, 3, "ip"), (2, 4, "card"), (5, 6, "phone")]) == "a[IP]e[PHONE]"


def test_tagger_on_held_out_examples(spark):
    """Of generated values that no pattern matches most are found, and hardly any other text is."""
    from hornlake.llm.pii_examples import KINDS, Examples
    from hornlake.llm.tagger import loaded, packed

    tagger = loaded(packed(pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))))
    text, gold = Examples(77).text(60_000)
    base = pii.base_spans(text)
    more = pii.model_spans(text, tagger.tag([text], pii.possible([text]))[0], base)
    missed = [g for g in gold if not any(a < g[1] and g[0] < b for a, b, _ in base)]
    hit = [g for g in missed if any(a < g[1] and g[0] < b and kind == KINDS[g[2] - 1] for a, b, kind in more)]
    wrong = [m for m in more if not any(a < m[1] and m[0] < b for a, b, _ in gold)]
    assert len(missed) > 200 and len(hit) >= 0.9 * len(missed) and len(wrong) <= 0.02 * len(more)


def test_query_of_personal_data(spark, tmp_path):
    """The digest columns of the query against the patterns, and its spans against the operator's."""
    from hornlake.llm.queries import op8_pii

    texts = [None, "", "a@b.co 1.2.3.4 +49 30 1234567 4111 1111 1111 1111 +4111111111111111", "x 10.0.0.1 c@d.ef", "call 415-555-2671 now", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    more = {r["doc_id"]: {f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if not s["base"]} for r in pii.find_pii(docs, pii.fit(docs)).collect()}
    for r in op8_pii(spark, str(tmp_path)).collect():
        base = [(k, a, b) for a, b, k in brute_pii(texts[r["doc_id"]] or "")]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(spelled))
        assert [s for s in r["spans"].split(",") if s and s not in more[r["doc_id"]]] == spelled
        assert set(r["spans"].split(",")) - {""} == set(spelled) | more[r["doc_id"]]


def test_viterbi_is_the_best_of_all_sequences():
    from itertools import product

    from hornlake.llm.pii_examples import Examples
    from hornlake.llm.tagger import Tagger, train

    tagger = Tagger(train(Examples(3).batches(5, 8, 16), 5))
    rng = np.random.default_rng(1)
    lengths = np.array([5, 4, 4, 1])
    e = rng.normal(size=(5, 5, 4)).astype(np.float32)
    tagger.moves = rng.normal(size=(5, 5)).astype(np.float32)
    inner, outer = np.array([True, False, True, False]), np.array([False, True, True, False])
    path = tagger._viterbi(e, lengths, inner, outer)
    for k, n in enumerate(lengths):
        def score(s, k=k, n=n):
            moves = sum(tagger.moves[a, b] for a, b in zip(s, s[1:], strict=False))
            return sum(e[t, x, k] for t, x in enumerate(s)) + moves + inner[k] * tagger.moves[0, s[0]] + outer[k] * tagger.moves[s[-1], 0]

        assert tuple(path[:n, k].tolist()) == max(product(range(5), repeat=n), key=score)


def test_windows_do_not_change_labels_in_their_depth():
    from hornlake.llm.pii_examples import Examples
    from hornlake.llm.tagger import Tagger, train

    weights = train(Examples(3).batches(60, 32, 48), 5)
    text, _ = Examples(8).text(3000)
    whole = Tagger(weights, window=4000, overlap=32).tag([text])[0]
    cut = Tagger(weights, window=256, overlap=64).tag(["", text, "a"])
    assert [len(x) for x in cut] == [0, len(text), 1] and (whole != cut[1]).mean() < 0.02


# 9


def brute_repeats(rows, size=20):
    docs = {}
    for i, t in rows:
        docs.setdefault(i if i is not None else 2**63 - 1, []).append(SPACED(t or ""))
    first = {}
    for i in sorted(docs):
        for w in docs[i]:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                first[g] = min(first.get(g, (i, k)), (i, k))
    out = []
    for i, t in rows:
        w = SPACED(t or "")
        gone = {x for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < (i if i is not None else 2**63 - 1, k) for x in range(k, k + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept), kept))
    return out


def test_substrings(spark):
    rows = [*zip(IDS, TEXTS, strict=True), (None, TEXTS[70]), (None, TEXTS[70] + " x"), (IDS[5], "other text " * 15), (IDS[6], TEXTS[71])]
    df = table(spark, [t for _, t in rows], [i for i, _ in rows])
    expected = brute_repeats(rows)
    assert sum(r[2] for r in expected) > 500
    found = substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    cut = substrings.remove_repeats(df, block_segments=1).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    assert sorted(map(tuple, cut), key=order) == sorted(expected, key=order)
    assert substrings.remove_repeats(table(spark, [])).count() == 0
    with pytest.raises(TypeError):
        substrings.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_factors_are_those_of_a_greedy_parse():
    rng = random.Random(4)
    for size in (2, 4):
        for _ in range(60):
            runs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(5)]
            order = rng.sample(range(5), 5)
            where = [(order[r], k) for r, run in enumerate(runs) for k in range(len(run))]
            lengths = np.array([len(r) for r in runs])
            index = substrings.Index(np.array([x for r in runs for x in r]), lengths)
            ids, start = (np.array([w[k] for w in where]) for k in (0, 1))
            longest = index.earlier(substrings._dense(ids, start), size)

            def best(r, k, runs=runs, order=order, size=size):
                """The longest run from word k of run r that begins earlier in the order of runs and words."""
                out = 0
                for q, other in enumerate(runs):
                    for j in range(len(other)):
                        if (order[q], j) < (order[r], k):
                            n = 0
                            while k + n < len(runs[r]) and j + n < len(other) and runs[r][k + n] == other[j + n]:
                                n += 1
                            out = max(out, n)
                return out if out >= size else 0

            assert longest.tolist() == [best(r, k) for r, run in enumerate(runs) for k in range(len(run))]
            greedy, at = [], 0
            for r, run in enumerate(runs):
                k = 0
                while k + size <= len(run):
                    n = best(r, k)
                    if n:
                        greedy.append((at + k, n))
                    k += max(n, 1)
                at += len(run)
            place, words = substrings.parse(index, longest, size)
            found = list(zip(place.tolist(), words.tolist(), strict=True))
            assert sorted(found[: len(greedy)]) == greedy
            covered = {p + x for p, n in found for x in range(n - size + 1)}
            assert covered == {p for p in range(len(longest)) if longest[p]}


def test_classes_remembered_take_a_fixed_size():
    """What a task remembers to have sent does not grow with its classes; no class goes unsent, nor an earlier place of one."""
    rng = np.random.default_rng(3)
    sent = substrings.Sent(4)
    least: dict[tuple[int, int], tuple[int, int]] = {}
    told: dict[tuple[int, int], tuple[int, int]] = {}
    for _ in range(30):
        key, mark = rng.integers(0, 12, (2, 50)).astype(np.uint64)
        ids, start = rng.integers(0, 40, (2, 50))
        for k in sent.fresh(key, mark, ids, start).tolist():
            told[int(key[k]), int(mark[k])] = min(told.get((int(key[k]), int(mark[k])), (99, 99)), (int(ids[k]), int(start[k])))
        for c, place in zip(zip(key.tolist(), mark.tolist(), strict=True), zip(ids.tolist(), start.tolist(), strict=True), strict=True):
            least[c] = min(least.get(c, (99, 99)), place)
        assert told == least
    big = substrings.Sent()
    key, mark = np.arange(50, dtype=np.uint64) << np.uint64(40), np.zeros(50, np.uint64)
    assert big.fresh(key, mark, ids, start).tolist() == [*range(50)] and not len(big.fresh(key, mark, ids, start))
    assert big.fresh(key, mark, ids, start - 1).tolist() == [*range(50)]
    assert sum(x.nbytes for x in (big.key, big.mark, big.id, big.start)) == 8 << 20


def test_substrings_cleaned_in_slices():
    """A batch of long texts comes back in parts of about a megabyte of text."""
    texts = [" ".join(f"w{k}x{j}" for j in range(30_000)) for k in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts), pa.nulls(12, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))], names=["doc_id", "text", "factors"])
    parts = list(substrings._cleaned(20)(iter([batch])))
    assert len(parts) > 2 and [x for b in parts for x in b.column(4).to_pylist()] == texts


def python_below_python(node, above=False) -> bool:
    """Whether a plan has two Python functions on one another with neither a join nor an exchange between."""
    here = node.nodeName() == "MapInArrow"
    if here and above:
        return True
    above = (above and node.nodeName() != "Join") or here
    return any(python_below_python(node.children().apply(k), above) for k in range(node.children().size()))


def test_substrings_take_one_worker_a_task(spark):
    """Two functions of one task hold a worker each until they are idle for long."""
    out = substrings.remove_repeats(table(spark, ["a b c", None]))
    assert not python_below_python(out._jdf.queryExecution().optimizedPlan())
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)


def peak_of(run) -> float:
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_texts_are_cut_into_words_by_pieces():
    """Workers of substrings and decontamination over a batch of 3 MB."""
    from types import SimpleNamespace as Some

    from hornlake.llm.words import _powers

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], names=["id", "h", "text"])
    every = Some(value=Some(has=lambda x: np.ones(len(x), bool)))
    runs = [substrings._anchors(20, 8), substrings._members(20, 8, every), substrings._classes(20, 8, every)]
    context = Some(sparkContext=Some(broadcast=lambda x: Some(value=x)))
    windows = decontaminate.Windows(["i"], [texts[5]], 10)
    keys = {3: np.unique(np.concatenate([h for n, _, h in windows.shingles() if n == 3]))}
    docs = Some(sparkSession=context, columns=["text", "n", "spans", "items"], schema=None, mapInArrow=lambda f, _: f)
    tables = [batch] * 3
    spans = pa.array([[]] * 1000, decontaminate._SPANS)
    tables.append(pa.RecordBatch.from_arrays([batch.column(2), pa.array(np.zeros(1000, np.int64)), spans, pa.array([[]] * 1000, pa.list_(pa.string()))], names=docs.columns))
    runs.append(decontaminate._pass(docs, decontaminate.Index(windows, keys, {3: np.ones(len(keys[3]), np.int64)})))
    for run, rows in zip(runs, tables, strict=True):
        _powers.cache_clear()
        assert peak_of(lambda run=run, rows=rows: [None for _ in run(iter([rows]))]) < 40e6
    hit = [k for b in runs[-1](iter([tables[-1]])) for k in b.column(3).to_pylist()]
    assert [k for k, items in enumerate(hit) if items] == [5]


def test_blocks_over_many_batches(spark):
    text = " ".join(f"w{k % 37}" for k in range(400))
    rows = [(k, f"{text} end{k}") for k in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(table(spark, [t for _, t in rows])).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {i: n for i, _, n, *_ in brute_repeats(rows)}


def test_windows_of_one_anchor_with_like_hashes(spark):
    """Two windows that share their anchor and the upper half of their hash, but no other word."""
    anchor = " ".join(f"p12537x{j}" for j in range(8))
    texts = [" ".join([anchor, *(f"t{k}y{j}" for j in range(12))]) for k in (43818, 79866)]
    rows = list(enumerate([*texts, texts[1]]))
    found = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(table(spark, [t for _, t in rows])).collect()}
    assert found == {0: 0, 1: 0, 2: 20} == {i: n for i, _, n, *_ in brute_repeats(rows)}


def test_rows_without_id_with_like_text_hashes(spark):
    """Two texts whose hashes have the same lower 23 bits; the shorter has no room for the other's factors."""
    passage = " ".join(f"r{k}" for k in range(30))
    rows = [(None, f"{passage} {passage} 314"), (None, "short 13053")]
    found = substrings.remove_repeats(table(spark, [t for _, t in rows], [None, None])).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == sorted(brute_repeats(rows), key=lambda r: r[1])


# 10


def brute_near(rows, percent, n=5):
    sets = []
    for _, t in rows:
        w = SPACED((t or "").translate(_A_Z))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i if i is not None else 10**9), i if i is not None else 10**9)
    return [(i, len(s), None if i is None else least[root(k)], i is None or least[root(k)] == i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, percent):
    rng = random.Random(percent)
    base = [f"t{k}" for k in range(120)]
    group = []
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(120)] = f"n{rng.randrange(50)}"
        group.append(" ".join(own))
    texts = [*TEXTS, *group]
    ids = [*IDS, *range(2000, 2000 + len(group))]
    rows = [*zip(ids, texts, strict=True), (None, group[0]), (None, None), (2005, group[7] + " more"), (2005, "another text under one id, with words enough"), (1999, "another text under one id, with words enough !")]
    df = table(spark, [t for _, t in rows], [i for i, _ in rows])
    found = [tuple(r)[:4] for r in minhash.near_duplicates(df, percent=percent).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=order) == sorted(brute_near(rows, percent), key=order)
    if percent == 80:
        assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_every_signature_within_the_distance_shares_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for percent in (80, 85, 95):
        d = minhash.allowed(percent)
        a = rng.integers(0, 2**16, (50, 64)).astype(np.uint16)
        b = a.copy()
        for row in b:
            at = rng.choice(64, d, replace=False)
            row[at] ^= 1
        keys = []
        for s in (a, b):
            batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in s], pa.binary()), pa.array(np.arange(50))], names=["sig", "id"])
            found = {}
            for out in minhash._keys(d)(iter([batch])):
                for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                    found.setdefault(i, set()).add(k)
            keys.append(found)
        assert all(keys[0][i] & keys[1][i] for i in range(50))


def test_keys_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    inner = minhash._keys

    def keys(distance):
        def bounded(batches):
            rows = 0
            for batch in batches:
                rows += batch.num_rows
                if rows > 200:
                    raise ValueError("more than 200 documents in a task")
                yield from inner(distance)(iter([batch]))

        return bounded

    monkeypatch.setattr(minhash, "_keys", keys)
    monkeypatch.setattr(minhash, "DEALT", 100, raising=False)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(1200)]
    found = minhash.near_duplicates(table(spark, [*texts, texts[7]]), percent=85).collect()
    assert len(found) == 1201 and sum(not r["kept"] for r in found) == 1


def test_families_cut_texts_into_words_by_pieces():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join([*base[:k], "x", *base[k:]]) for k in range(0, 1500, 5)]
    n = len(texts)
    sig = np.zeros((1, minhash.HASHES), np.uint16).tobytes()
    numbers = [pa.array(np.zeros(n, np.int64))] * 4 + [pa.array(np.arange(n))] * 2
    unit = pa.RecordBatch.from_arrays([*numbers, pa.array([sig] * n, pa.binary()), pa.array(texts)], names=["fam", "lo", "hi", "side", "id", "c", "sig", "text"])
    tracemalloc.start()
    try:
        links = [out.num_rows for out in minhash._families(5, 85, 30)(iter([unit]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, texts)) > 3e6 and sum(links) == n - 1
    assert peak < 100e6


def test_products_and_single_comparisons_agree():
    rng = random.Random(1)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(40)], dtype=np.uint64)) for _ in range(60)]
    i, j = (x.astype(np.int64) for x in np.triu_indices(60, 1))
    comps = np.arange(60)
    exact = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 55 * len(np.union1d(sets[a], sets[b]))}
    old = minhash.COLUMNS
    try:
        minhash.COLUMNS = 16
        by_product = {*zip(*(x.tolist() for x in minhash._similar(sets * 1, i, j, comps, 55)), strict=True)}
    finally:
        minhash.COLUMNS = old
    assert by_product <= exact and len(by_product) > 0
    from hornlake.llm.components import forest

    a, b = zip(*sorted(exact), strict=True)
    c, d = zip(*sorted(by_product), strict=True)
    assert {*zip(*(x.tolist() for x in forest(np.array(a), np.array(b))), strict=True)} == {*zip(*(x.tolist() for x in forest(np.array(c), np.array(d))), strict=True)}


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for p in links for x in p}
    assert found == {x: root(x) for x in nodes if root(x) != x}
