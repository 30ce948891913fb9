import hashlib
import re

import duckdb
import plain
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from inkwell.llm import byte_bpe
from inkwell.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(40, texts[0], "en", "s0", 1), (41, texts[1] + " extra", "en", "s1", 1), (42, "short", "en", "s1", 5), (43, None, None, None, None), (44, texts[5] + " " + texts[6] + " mail me@x.org", "en", None, 1), (44, texts[5] + " " + texts[6] + " mail me@x.org", "en", None, 1)]
    out = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table([list(c) for c in zip(*rows, strict=True)], names=["doc_id", "text", "lang", "source", "n_chars"]), out / "documents.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*range(42), 44}
    unique = stages["near_dedup"](spark, kept, folder)
    assert sorted(r["doc_id"] for r in unique.collect()) == [*range(40), 44]
    clean = stages["personal_data"](spark, unique, folder)
    row = clean.where("doc_id = 44").first()
    assert row["text"].endswith("mail [EMAIL]") and row["n_chars"] == len(row["text"]) and clean.columns == docs.columns
    mixed = stages["mixing"](spark, clean, folder)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * 41


def test_run_against_plain_python(spark, folder):
    """Every row of run(): rules by the query's SQL, groups by all pairs, patterns by re, the draw by sorting, ids by tiktoken."""
    db = duckdb.connect()
    rows = db.sql(f"SELECT doc_id, text, source, row_number() OVER () AS row FROM '{folder}/documents.parquet'").fetchall()
    rows = [(i, t, s) for i, t, s, _ in rows]
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, t, s) for k, (_, t, s) in enumerate(rows)])
    good = {r[0] for r in db.sql(f"SELECT doc_id, kept FROM ({ORACLE_SQL['op7_host_rules']})").fetchall() if r[1]}
    kept = [rows[k] for k in sorted(good)]
    kept = [r for i, r in enumerate(kept) if r not in kept[:i]]  # equal rows are one document
    root = plain.components([(k, t) for k, (_, t, _) in enumerate(kept)], 5, 80)
    unique = [kept[k] for k in sorted({*root.values()})]
    clean = [(i, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t), s) for i, t, s in unique]
    copies = plain.mix([(i, s, len(plain.WORD.findall(t))) for i, t, s in clean])
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    told = sorted((i, coder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in clean for _ in range(copies[i]))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in got) == told
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_repeated_ids_and_clashing_columns(spark):
    """Unlike texts of one id are documents of their own, equal rows are one; columns may have any names."""
    import random

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randint(0, 99)) for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (1, two), (None, three), (None, None), (None, three + " more"), (2, one + " end"), (3, ""), (3, "")]
    frame = [(i, t, "en", "s", 1, "x", "y", "z", 5, {"k": 1}) for i, t in rows]
    docs = spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long, _copies string, _id string, row_id string, kept int, extra map<string,int>")
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["near_dedup"](spark, docs, "")
    assert unique.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert len(got) == 6 and sum(t in (one, one + " end") for _, t in got) == 1 and got.count((1, two)) == 1
    assert sum((t or "").startswith(three) for _, t in got) == 1 and got.count((None, None)) == 1 and got.count((3, "")) == 2
    again = stages["near_dedup"](spark, docs.repartition(4), "")
    assert sorted(map(str, got)) == sorted(str((r["doc_id"], r["text"])) for r in again.collect())
    rules = stages["quality_rules"](spark, docs, "")
    assert rules.columns == docs.columns and sorted(str(r["text"]) for r in rules.collect()) == sorted([one, two, two, three, three + " more", one + " end"])
    clean = stages["personal_data"](spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == 9
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and {r["text"] for r in mixed.collect()} == {one, two, three, three + " more", one + " end"}
    coded = stages["byte_bpe"](spark, docs, "")
    assert coded.count() == 9 and sum(r["n_tokens"] == 0 for r in coded.collect()) == 3


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
