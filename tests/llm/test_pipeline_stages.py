"""The pipeline on a small planted corpus, stage by stage, with nulls, clashing columns and empty tables."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

RNG = random.Random(23)
WORDS = ["".join(RNG.choices("abcdeghilmnorstu", k=RNG.randint(2, 8))) for _ in range(2_000)]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, own string, key string, bands string, sequence_id string"


def prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


ITEM = prose(15)
TEXTS = {i: prose(120) for i in range(1, 9)}
TEXTS |= {20: TEXTS[1], 21: TEXTS[1], 30: TEXTS[2] + " extra words", 31: " ".join(TEXTS[3].split()[:60]) + " " + prose(60),
          40: f"{prose(50)} {ITEM} {prose(50)}", 41: f"{prose(30)} {' '.join(ITEM.split()[:9])} {prose(30)}", 42: ITEM.upper(),
          50: None, 51: "", 60: "two words", 61: prose(6_000)}
ROWS = [*TEXTS.items(), (None, prose(40)), (5, prose(70))]


def written(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s", 1, "o", "k", "b", "q") for i, t in rows], KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, ITEM), (8, None), (None, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    sf = written(spark, tmp_path / "sf", ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(i, t) for i, t in ROWS]
    gone = {"toxicity": set(), "quality": set(), "near_dedup": {20, 21, 30, 51}, "decontamination": {40, 42}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        rows = [(i, t) for i, t in rows if i not in gone[name]]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(rows, key=repr), name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    check_packed(corpus_pipeline.run(spark, sf).collect(), rows)


def check_packed(pieces, rows):
    """Every id of every text stands in exactly one place, and sequences have no gap."""
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    want = sorted((str(i), (*encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for (i, n), parts in by_doc.items():
        at = 0
        ids = next(x for k, x in want if k == str(i) and len(x) == n)
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at:at + p.length]))
            at += p.length
        assert at == n
    assert sorted((str(i), n) for i, n in by_doc) == sorted((i, len(x)) for i, x in want)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1_024


def test_empty_corpus(spark, tmp_path):
    sf = written(spark, tmp_path / "sf", [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns and not stage(spark, docs, sf).count(), name
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.parametrize("text", [None, "", "one"])
def test_one_row(spark, tmp_path, text):
    pieces = corpus_pipeline.run(spark, written(spark, tmp_path / "sf", [(3, text)])).collect()
    check_packed(pieces, [(3, text)])
