"""Texts with a morphological analyser's tokens, columns whose names clash, and line ends that aren't \\n."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import lexical, rhythm
from inkwell.profiles import JAPANESE, LATIN_BLOCKS

KNOWN = {
    "猫": ("名詞", "普通名詞", "猫", "ネコ"), "が": ("助詞", "", "が", "ガ"), "走る": ("動詞", "一般", "走る", "ハシル"), "今日": ("名詞", "普通名詞", "今日", "キョー"),
    "いい": ("形容詞", "非自立可能", "良い", "イー"), "日": ("名詞", "普通名詞", "日", "ヒ"), "」": ("補助記号", "括弧閉", "」", ""), "二": ("名詞", "数詞", "二", "ニ"),
}


@pytest.fixture
def toy():
    known = KNOWN

    def analyse(sentence):
        """Longest known words; anything else is a symbol of one character."""
        at, out = 0, []
        while at < len(sentence):
            found = next((w for n in (2, 1) if (w := sentence[at : at + n]) in known), None)
            out.append((found, *known[found]) if found else (sentence[at], "記号", None, None, None))
            at += len(found or sentence[at])
        return out

    return analyse


def test_japanese_metrics_with_tokens(spark, toy):
    raw = "猫が走る。今日いい日」。猫が走る。日。猫。\n\n- 猫が走る\n\n今日。"
    row = rhythm.metrics(spark.createDataFrame([(1, raw)], "doc_id long, text string"), JAPANESE, toy).first()
    morae = [6, 5, 6, 1, 2, 6, 2]  # ネコガハシル, キョーイーヒ (small ョ doesn't count), ...
    mean = sum(morae) / 7
    sd = (sum((m - mean) ** 2 for m in morae) / 7) ** 0.5
    assert row["n_sentences"] == 7 and row["n_sentences_prose"] == 6
    assert row["sent_len_mora_mean"] == pytest.approx(mean) and row["burstiness_mora"] == pytest.approx((sd - mean) / (sd + mean))
    assert row["noun_ending_rate"] == pytest.approx(4 / 6)  # 日, 日, 猫, 今日; the list item isn't prose
    # が/助詞|走る/動詞 twice, いい/形容詞|日/名詞, 日/名詞, 猫/名詞, 今日/名詞
    assert row["ending_bigram_ttr"] == pytest.approx(5 / 6) and row["n_endings"] == 6 and row["mattr20"] == pytest.approx(5 / 6)


def test_japanese_without_tokens_is_unknown(spark):
    row = rhythm.metrics(spark.createDataFrame([(1, "猫が走る。" * 6)], "doc_id long, text string"), JAPANESE).first()
    assert row["sent_len_char_mean"] == 4 and row["burstiness_char"] == -1
    assert all(row[c] is None for c in ("sent_len_mora_mean", "burstiness_mora", "noun_ending_rate", "ending_bigram_ttr", "mattr20"))


def test_content_words(spark, toy):
    docs = spark.createDataFrame([(1, "# 猫が走る、二 `今日` いい日"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lexical.doc_words(docs, JAPANESE, toy).collect()}
    assert rows[1]["words"] == ["猫", "良い", "走る", "日"] or sorted(rows[1]["words"]) == sorted(["猫", "走る", "良い", "日"])
    assert rows[1]["n_tokens"] == 4 and rows[2]["n_tokens"] == 0 and rows[2]["words"] == []
    with pytest.raises(ValueError, match="analyser"):
        lexical.doc_words(docs, JAPANESE)


def test_clashing_columns(spark):
    names = ["doc_id", "paras", "sents", "chars", "joined", "ends", "m_char", "row", "tokens", "_tokens", "words", "n_tokens", "n_sentences", "odd name.x"]
    docs = spark.createDataFrame([(1, *["kept"] * (len(names) - 1), "One. Two.")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in [*names, "text"]))
    row = rhythm.metrics(docs).first()
    assert row["n_sentences"] == 2 and all(row[n] == "kept" for n in names if n not in ("doc_id", "n_sentences"))
    row = lexical.doc_words(docs).first()
    assert row["words"] == ["one", "two"] and row["n_tokens"] == 2 and all(row[n] == "kept" for n in names if n not in ("doc_id", "words", "n_tokens"))


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("前文 # 見出し い。", ["前文 # 見出し い"]),  # only \n ends a line
        ("前\u0085```\u0085い。\nう。", ["前\u0085`\u0085い", "う"]),
        ("あ\r# い。", ["あ\r# い"]),
        ("٣) あ。", ["あ"]),  # list markers take any decimal digits
    ],
)
def test_line_ends(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "t string").select(text.paragraphs(F.col("t"), JAPANESE).alias("p")).first()
    assert [s["text"] for p in row["p"] for s in p] == expected


def test_blocks_of_latin(spark):
    raw = "One. Two\nthree.\n\n~~~\nhidden.\n~~~\n| a | b |\nFour.\n***\nFive."
    rows = rhythm.sentence_table(spark.createDataFrame([(1, raw)], "doc_id long, text string"), LATIN_BLOCKS).orderBy("sent_no").collect()
    assert [(r["para_no"], r["text"]) for r in rows] == [(1, "One"), (1, "Two"), (1, "three"), (2, "Four"), (3, "Five")]
