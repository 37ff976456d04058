"""Results against plain Python on small fixtures, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shopstream.llm import ngram_join, pii, queries, quality_rules, warc
from shopstream.llm.common import connected
from shopstream.llm.decontaminate import suffix_array
from shopstream.llm.license_scan import Scanner, settle
from shopstream.llm.textvec import ALNUM, NON_SPACE, words


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))


def shingled(text: str, size: int) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(sets: dict, percent: int) -> dict:
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_components_with_large_groups_of_near_copies(spark, size, percent):
    rng = random.Random(size)
    texts, base = {}, [word(rng) for _ in range(120)]
    for i in range(150):  # one group with all degrees of change, and others of few words
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            t[rng.randrange(len(t))] = word(rng)
        texts[i] = " ".join(t)
    for i in range(150, 200):
        texts[i] = " ".join(word(rng) for _ in range(rng.randint(1, 9)))
    for i in range(200, 215):
        texts[i] = texts[rng.randrange(200)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.ngram_components(docs, size=size, percent=percent).collect()}
    sets = {i: shingled(t, size) for i, t in texts.items()}
    want = components(sets, percent)
    assert got == {i: (want[i], len(sets[i])) for i in texts}


def test_prefixes_always_meet():
    """Any two sets that reach the threshold share an index entry whose ranks lie in both prefixes."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        percent = int(rng.choice([60, 80, 85]))
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 90)).astype(np.uint64))
        keep = rng.random(len(x)) > rng.choice([0, 0.05, 0.1])
        y = np.unique(np.concatenate([x[keep], rng.integers(0, 1 << 60, rng.integers(0, 8)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or np.array_equal(x, y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        common = rng.random() * 1.2
        often = lambda t: (t % np.uint64(997)) / 997 < common  # noqa: B023, E731
        need = -(-percent * (len(x) + len(y)) // (100 + percent))
        sides = []
        for t in (x, y):
            sig, rank, _ = ngram_join.entries(t, often(t), percent)
            sides.append({s for s, v in zip(sig.tolist(), rank.tolist(), strict=True) if v <= len(t) - need})
        assert sides[0] & sides[1]


def test_connected_follows_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(5, 5), (100, 99)], "a long, b long")
    assert {r.id: r.label for r in connected(edges).collect()} == dict.fromkeys(range(10, 41), 10) | {99: 99, 100: 99}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (50, 1), (300, 2), (500, 40)):
        codes = rng.integers(1, kinds + 1, n)
        want = sorted(range(n), key=lambda i: codes[i:].tolist())
        assert suffix_array(codes).tolist() == want


def test_longest_matches_are_maximal(spark):
    from shopstream.llm.decontaminate import benchmark_matches

    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"q {item[:23]} z {item[4:]}"), (3, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, "a b c")], "item_id long, text string")
    for block in (32_000_000, 20):  # one block, and several
        out = {r.row.doc_id: r for r in benchmark_matches(docs, bench, ["doc_id"], block_bytes=block).collect()}
        assert [(m.item_id, m.doc_word, m.item_word, m.n_words) for m in out[1].matches if m.item_id == 9] == [(9, 1, 0, 14)]
        assert (out[1].n_hit, out[1].item_ids, out[3].item_ids, out[3].n_hit) == (14, [8, 9], [8], 3)
        assert out[2].n_hit == 12 + 12


def test_words_match_their_patterns():
    texts = ["Héllo wörld\x0bA\x1cB  c-d_9", "", "  x", "\ty\n", "€ ¿qué? ǅ"]
    for table, pattern in ((NON_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(pa.array(texts), table)
        got = [[w.text(i).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(w.rows)]
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
        assert got == [re.findall(pattern, t) for t in lower]


def test_licences():
    scan = Scanner()
    assert len(scan.rules) > 300
    out = scan(pa.array(["Licensed under CC BY-NC 4.0. All rights reserved", "the GNU General Public License, version 3", "words only", "SPDX-License-Identifier: Apache-2.0"]))
    labels = [[d["label"] for d in x] for x in out[2].to_pylist()]
    assert labels == [["cc-by-nc-4.0", "reserved"], ["gpl-3.0"], [], ["apache-2.0"]]
    assert out[1].to_pylist()[0] == [{"word": 2, "label": "cc-by"}, {"word": 7, "label": "reserved"}]
    assert settle([(0, 5, 1, "low", 0.1), (1, 3, 9, "high", 0.9), (1, 2, 5, "inside", 0.5), (4, 8, 1, "beside", 0.1)]) == [(0, 5, 1, "low", 0.1), (1, 3, 9, "high", 0.9), (4, 8, 1, "beside", 0.1)]


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def entities(text: str) -> str:
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else False, 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_entities_equal_their_patterns(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "_d@e-f.g", "x..y@z.q.", "1.2.3.4", ".5.6.7", "256", "4111 1111-1111 1111", "4111111111111111", " - ", "+1 (212) 555-1234", "+", "é", "€", "", "", "٣", "@", ".", "-", " ", "00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.b for r in pii.personal_data(docs, ["doc_id"]).select("row.doc_id", pii.listed("base").alias("b")).collect()}
    assert got == {i: entities(t) for i, t in enumerate(texts)}


def test_a_name_beside_an_address_is_a_term_and_is_removed(spark):
    filler = ["the report of today came in late", "we saw nothing else in this place", "many people went home after that", "no one knows what it was about"]
    texts = [f"{filler[i % 4]} number{i} and more" for i in range(60)]
    texts += [f"{w} asked Zebulon via zz@corp.example about {w} today" for w in ("anna", "bert", "carl", "dora")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert out[60] == "anna asked  via <email> about anna today".replace("asked  via", out[60][5 : out[60].index("<") - 1]) and "Zebulon" not in out[60] and "zz@" not in out[60]
    assert out[3] == texts[3]


def test_repeated_words_and_other_statistics(spark):
    rng = random.Random(9)
    texts = ["", "a b c d e f g h " * 3, "x", *(" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 30, 80)), "l one\nl one\n \nl two\n", "# $% a|b <c>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r.stats) for r in quality_rules.text_statistics(docs).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert got[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_outliers_are_rejected_and_the_bulk_is_kept(spark):
    rng = np.random.default_rng(1)
    good = [(float(a), float(b), float(abs(c)), 0.0) for a, b, c in rng.normal([6, 1.7, 0.2], [0.5, 0.05, 0.1], (300, 3))]
    odd = [(6.0, 1.7, 4.5, 4.0)] * 40
    rows = spark.createDataFrame([("g", *x) for x in good + odd], "g string, v0 double, v1 double, v2 double, v3 double")
    found = rows.join(quality_rules.estimates(rows).drop("n"), "g").withColumn("d", quality_rules.squared_distance())
    assert found.where(f"v2 > 4 and d > {quality_rules.CUTOFF}").count() == 40
    assert found.where(f"v2 < 4 and d > {quality_rules.CUTOFF}").count() == 0


def test_archives_come_back_whole(spark):
    big = "é" * 100_000
    pages = spark.createDataFrame([(3, "http://a/ b", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (4, "u", ""), (5, "v", big), (None, "w", "solo")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages), 65_536).collect()
    last = {r.page_id: r for r in rows if r.last}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert [(i, last[i].record_type, last[i].refers_to) for i in (1, 2, 3, 4, 5)] == [(1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None)]
    assert last[5].payload_digest == digest(big) and last[3].payload_digest == digest("<p>x</p>") and last[3].payload_bytes == 8
    parts = sorted((r.chunk, r.data, r.sha1_so_far) for r in rows if r.page_id == 5)
    assert len(parts) == 4 and b"".join(p[1] for p in parts).decode() == big and parts[-1][2] == hashlib.sha1(big.encode()).hexdigest()


def test_packed_pieces_are_the_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    rows = queries.op8_packing(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == doc_id].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    sizes = rows.groupby("sequence_id").length.sum()
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)


@pytest.mark.parametrize(("name", "label", "least"), [("op10_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert out.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.97


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline
    from shopstream.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        assert docs.count() <= n
        n = docs.count()
    sets = {r.doc_id: shingled(r.text or "", 5) for r in docs.collect()}
    labels = components({i: s for i, s in sets.items() if s}, 90)
    assert len(set(labels.values())) > 0.98 * len(labels)  # sanitising may make a few alike
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).agg(F.count_distinct("doc_id")).first()[0] == n
