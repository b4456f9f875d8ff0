"""The registered queries at the smallest scale, and the pipeline against plain Python."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import mixing, quality_classifier
from keyloom.llm.hashing import shingles
from keyloom.llm.queries import TOKENIZERS, oracle_sql, queries
from tests.conftest import DATA

#: The columns that the contracts name.
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_token_counts": "source lang tokenizer n_docs n_tokens",
    "op4_sentencepiece": "doc_id n_pieces round_trip",
    "op5_quality_classifier": "doc_id held_out score predicted",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_url_filters": "page_id host path rule verdict",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_nearest": "query_id rank vec_id score",
    "op10_near_duplicates": "doc_id n_shingles component_id kept",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    found = queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = found.collect()
    table = {"op7_url_filters": "pages"}.get(name, "documents")
    if name not in ("op3_token_counts", "op9_nearest"):
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    if name in oracle_sql():
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        relation = con.sql(oracle_sql()[name])
        order = [relation.columns.index(c) for c in found.columns]
        assert sorted(map(tuple, rows), key=repr) == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)


def test_held_out_quality(spark):
    """On documents that it has not learnt from, the classifier tells good from bad."""
    sf = DATA.replace("sf0.001", "sf0.01")
    got = queries()["op5_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95


def test_held_out_likelihood(spark):
    sums = queries()["op2_lm_scoring"](spark, DATA).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert sums.s > sums.b


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def test_token_counts_against_plain_python(spark):
    import base64
    import re

    import tiktoken

    from keyloom.llm import token_counts
    from keyloom.llm.queries import MAIL

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("plain", pat_str=token_counts.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows_of(spark, "documents"):
        text = re.sub(MAIL, "<mail>", r.text)
        if len(text.split()) < 5:
            continue
        for name, n in (("byte_bpe_50k/1", len(bpe.encode_ordinary(text))), ("words/1", len(text.split()))):
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += n
            want[r.source, r.lang, name, "bytes"] += len(text.encode())
    got = {(r.source, r.lang, r.tokenizer, k): n for r in queries()["op3_token_counts"](spark, DATA).collect() for k, n in (("docs", r.n_docs), ("tokens", r.n_tokens), ("bytes", r.n_bytes))}
    assert got == dict(want)


def test_quality_classifier_against_plain_python(spark):
    order = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    texts = {r.doc_id: r.text.encode() for r in rows_of(spark, "documents")}
    known = {r.doc_id: r.quality for r in rows_of(spark, "labels") if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    model = quality_classifier.fit_texts([texts[i] for i in order if known.get(i) == 1], [texts[i] for i in order if known.get(i) == 0], quality_classifier.Settings())
    got = {r.doc_id: r for r in queries()["op5_quality_classifier"](spark, DATA).collect()}
    want = dict(zip(texts, model.scorer()(list(texts.values())), strict=True))
    assert set(got) == set(want) and all(abs(got[i].score - want[i]) < 1e-9 and got[i].predicted == (want[i] >= 0.5) for i in want)


def test_mixing_against_plain_python(spark):
    """Documents of each source in seeded order while they fit, then the one nearest in size to what is missing."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()
    sized = spark.createDataFrame([(r.doc_id, len(r.text.split()), r.source) for r in rows], "doc_id long, size long, source string")
    place = {r.doc_id: r.h % (1 << 64) for r in sized.select("doc_id", F.xxhash64(F.lit(0), "doc_id", "size").alias("h")).collect()}
    own, size = {}, {}
    for r in sized.collect():
        own.setdefault(r.source, []).append(r.doc_id)
        size[r.doc_id] = r["size"]
    targets = mixing.weighted_targets({s: sum(size[i] for i in ids) for s, ids in own.items()})
    want = {}
    for s, ids in own.items():
        base, left = divmod(min(round(targets[s]), 2 * sum(size[i] for i in ids)), sum(size[i] for i in ids))
        line, more = sorted(ids, key=place.get), set()
        for i in line:
            if size[i] > left:
                break
            more.add(i)
            left -= size[i]
        spare = [(abs(size[i] - left), (place[i] + (1 << 63)) % (1 << 64), i) for i in line if i not in more and 0 < size[i] < 2 * left]
        more |= {min(spare)[2]} if spare else set()
        want |= {i: min(2, base + (i in more)) * size[i] for i in ids}
    assert {r.doc_id: r.taken for r in queries()["op6_mixing"](spark, DATA).collect()} == want


def make_tables(spark, path):
    dice = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "st", "ren", "lo")]
    text = lambda n: " ".join(dice.choice(vocab) for _ in range(n))
    rows = [(i, text(dice.randint(60, 120)), "en", f"s{i % 3}", 1) for i in range(90)]
    rows += [(100 + i, " ".join(dice.choice(["BUY!!", "###now", "$$$", "free|"]) for _ in range(80)), "en", "s0", 1) for i in range(40)]
    rows += [(200 + i, "short text", "en", "s1", 1) for i in range(5)] + [(300 + i, rows[i][1] + " end", "en", "s1", 1) for i in range(20)] + [(320 + i, rows[0][1], "en", None, 1) for i in range(5)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (90, rows[40][1], "en", "s1", 1), (90, rows[40][1], "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("clash")).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(r[0], int(r[0] < 90), 0) for r in rows if r[0] < 140]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, marks


def python_rules(t):
    w = (t or "").split()
    wins = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p + k for p, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if wins[x] > 1 for k in range(3)}
    symbols, upper, chars = sum(c in "#*$%&|<>" for c in t or ""), sum("A" <= c <= "Z" for c in t or ""), sum(map(len, w))
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 100 * symbols <= 25 * len(w) and 100 * upper <= 50 * chars and 2 * chars >= 3 * len(w) and chars <= 30 * len(w)


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, marks = make_tables(spark, tmp_path)
    path = str(tmp_path)
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, path))
        left[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [r for r in rows if python_rules(r[1])]
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, left["quality rules"])) == sorted(map(key, want))

    ids = [r.id for r in spark.range(1000).orderBy(F.xxhash64("id")).collect()]
    known = {d: q for d, q, _ in marks if zlib.crc32(str(d).encode()) % 3 != 1}
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    model = quality_classifier.fit_texts([texts[i] for i in ids if known.get(i) == 1], [texts[i] for i in ids if known.get(i) == 0], quality_classifier.Settings())
    want = [r for r in want if model.scorer()([(r[1] or "").encode()])[0] >= 0.5]
    assert sorted(map(key, left["quality classifier"])) == sorted(map(key, want))

    sets = [(r[0], frozenset(shingles(r[1], 5).tolist())) for r in want]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    kept = {i: r for r in sorted(want, key=lambda r: (r[0], r[1]), reverse=True) for i in [r[0]] if top(i) == i}
    assert sorted(map(key, left["near duplicates"])) == sorted(map(key, kept.values()))

    mixed = Counter(r.doc_id for r in left["mixing"])
    sizes, taken = Counter(), Counter()
    for i, r in kept.items():
        sizes[r[3]] += len(r[1].split())
        taken[r[3]] += mixed[i] * len(r[1].split())
    targets = mixing.weighted_targets(dict(sizes))
    assert set(mixed) <= set(kept) and max(mixed.values()) <= 2 and all(abs(taken[s] - t) <= 120 for s, t in targets.items())

    spm = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    last = left["SentencePiece"]
    assert Counter(r.doc_id for r in last) == mixed and all(r.round_trip and r.piece_ids == spm.encode(kept[r.doc_id][1]) and r.n_pieces == len(r.piece_ids) for r in last)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == sorted(r.doc_id for r in last)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
