"""Sentence tables and rhythm metrics of documents. Metrics are folds over a document's own sentences: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import stats, text
from inkwell.profiles import LATIN, MATTR_WINDOW, MIN_PARAGRAPHS, MIN_SENTENCES, NOUN, Profile

METRICS = (
    "sent_len_char_mean", "sent_len_char_sd", "sent_len_char_cv", "sent_len_mora_mean", "sent_len_mora_sd", "sent_len_mora_cv",
    "burstiness_char", "burstiness_mora", "para_sent_cv", "comma_per_sentence", "phrase_per_sentence", "noun_ending_rate", "ending_bigram_ttr", "mattr20",
)


def sentence_table(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """doc_id, para_no, sent_no (in the document), text, is_list."""

    def numbered(sentences, i):
        return F.transform(sentences, lambda s: F.struct((i + 1).alias("para_no"), s["text"].alias("text"), s["is_list"].alias("is_list")))

    parsed = docs.select("doc_id", text.paragraphs(F.col("text"), profile).alias("paras"))
    flat = parsed.select("doc_id", F.flatten(F.transform("paras", numbered)).alias("all"))
    return flat.select("doc_id", F.posexplode("all").alias("at", "s")).select("doc_id", F.col("s.para_no").alias("para_no"), (F.col("at") + 1).alias("sent_no"), "s.text", "s.is_list")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.nullif(F.size(values), F.lit(0))


def _sd(values: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean)) / F.nullif(F.size(values), F.lit(0)))


def mattr(sequence: Column, window: int = MATTR_WINDOW) -> Column:
    """Moving-average type-token ratio; of a sequence not longer than the window, the plain ratio; of an empty one, null."""
    n = F.size(sequence)
    total = F.aggregate(F.sequence(F.lit(1), n - window + 1), F.lit(0.0), lambda t, i: t + F.size(F.array_distinct(F.slice(sequence, i, F.lit(window)))) / window)
    return F.when(n > window, total / (n - window + 1)).when(n > 0, F.size(F.array_distinct(sequence)) / n)


_SENTENCE = "struct<text:string,is_list:boolean>"


def metrics(docs: DataFrame, profile: Profile = LATIN, analyse: text.Analyser | None = None) -> DataFrame:
    """A row for each document: the columns of docs but text, counts, ``included`` and METRICS.

    Metrics are null below MIN_SENTENCES sentences. ``analyse`` gives the tokens of a sentence: then morae are those of the
    readings, endings are the last two content morphemes with their parts of speech, and noun_ending_rate is the share of
    sentences that end in a noun. Without it these are null for a profile that needs an analyser; LATIN takes runs of vowels
    and the last two words, and has no noun-ending rate. A null text has no sentences. Columns that are named like a result
    give way to it.
    """
    results = ("n_paragraphs", "n_sentences", "n_sentences_prose", "included", *METRICS, "n_endings", "window_used")
    others = [c for c in docs.columns if c != "text" and c not in results]
    row = F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("")).alias("row")
    parsed = docs.select(row, F.coalesce(text.paragraphs(F.col("text"), profile), F.array().cast(f"array<array<{_SENTENCE}>>")).alias("paras"))
    parsed = parsed.withColumn("sents", F.flatten("paras"))
    told = analyse is not None
    unknown = profile.analysed and not told
    if told:
        parsed = parsed.withColumn("tokens", text.analysed(F.transform("sents", lambda s: s["text"]), analyse))
        moras = F.transform("tokens", lambda t: text.morae(t).cast("double"))
        prose_tokens = F.transform(F.filter(F.arrays_zip("sents", "tokens"), lambda x: ~x["sents"]["is_list"]), lambda x: text.content_morphemes(x["tokens"]))
        finals = F.filter(prose_tokens, lambda t: F.size(t) > 0)
        ends = F.transform(finals, lambda t: text.last_bigram(text.endings(t)))
        nouns = F.size(F.filter(finals, lambda t: F.element_at(t, -1)["pos1"] == NOUN))
    else:
        moras = F.transform("sents", lambda s: text.syllables(s["text"]).cast("double"))
        words = F.transform(F.filter("sents", lambda s: ~s["is_list"]), lambda s: text.words(s["text"], profile))
        ends = F.transform(F.filter(words, lambda t: F.size(t) > 0), text.last_bigram)
        nouns = F.lit(None).cast("int")
    if unknown:
        moras, ends = F.array().cast("array<double>"), F.array().cast("array<string>")
    seen = parsed.select(
        "row", F.size("paras").alias("n_paragraphs"), F.size("sents").alias("n_sentences"), F.size(F.filter("sents", lambda s: ~s["is_list"])).alias("n_sentences_prose"),
        F.transform("sents", lambda s: F.length(F.replace(F.replace(s["text"], F.lit(" ")), F.lit("　"))).cast("double")).alias("chars"), moras.alias("moras"),
        F.transform("paras", lambda p: F.size(p).cast("double")).alias("para_sizes"),
        F.aggregate("sents", F.lit(0), lambda t, s: t + F.length(s["text"]) - F.length(F.translate(s["text"], profile.commas, ""))).alias("commas"),
        F.array_join(F.transform("sents", lambda s: s["text"]), "").alias("joined"), ends.alias("ends"), nouns.alias("nouns"),
    )
    for name in ("char", "mora"):
        seen = seen.withColumn(f"m_{name}", _mean(F.col(f"{name}s")))
        seen = seen.withColumn(f"s_{name}", _sd(F.col(f"{name}s"), F.col(f"m_{name}")))
    seen = seen.withColumn("m_para", _mean(F.col("para_sizes")))
    ok = F.col("n_sentences") >= MIN_SENTENCES
    prose_ok = ok & (F.col("n_sentences_prose") >= MIN_SENTENCES)
    n_ends = F.size("ends")
    phrase = (F.length("joined") - F.length(F.replace(F.col("joined"), F.lit(profile.phrase)))) / len(profile.phrase)
    values = {}
    for name in ("char", "mora"):
        m, s = F.col(f"m_{name}"), F.col(f"s_{name}")
        values |= {f"sent_len_{name}_mean": m, f"sent_len_{name}_sd": s, f"sent_len_{name}_cv": s / F.nullif(m, F.lit(0.0)), f"burstiness_{name}": stats.burstiness(s, m)}
    values["para_sent_cv"] = F.when(F.col("n_paragraphs") >= MIN_PARAGRAPHS, _sd(F.col("para_sizes"), F.col("m_para")) / F.col("m_para"))
    values["comma_per_sentence"] = F.col("commas") / F.col("n_sentences")
    values["phrase_per_sentence"] = phrase / F.col("n_sentences")
    out = [F.when(ok, values[k]).alias(k) for k in METRICS if k in values]
    out.append(F.when(prose_ok, F.col("nouns") / F.nullif(n_ends, F.lit(0))).alias("noun_ending_rate"))
    out.append(F.when(prose_ok, F.size(F.array_distinct("ends")) / F.nullif(n_ends, F.lit(0))).alias("ending_bigram_ttr"))
    gate = n_ends >= MIN_SENTENCES
    out += [F.when(gate, mattr(F.col("ends"))).alias("mattr20"), n_ends.alias("n_endings"), F.when(gate, F.least(n_ends, F.lit(MATTR_WINDOW))).alias("window_used")]
    made = F.struct("n_paragraphs", "n_sentences", "n_sentences_prose", ok.cast("int").alias("included"), *out).alias("made")
    return seen.select("row", made).select(*(F.col(f"row.`{c}`") for c in others), *(F.col(f"made.{c}") for c in results))


def covariates(rows: DataFrame) -> DataFrame:
    """Adds n_chars_total and the logarithms of sentences and characters."""
    total = F.col("sent_len_char_mean") * F.col("n_sentences")
    return rows.withColumn("n_chars_total", total).withColumn("cov_log_sentences", F.log1p("n_sentences")).withColumn("cov_log_chars", F.log1p("n_chars_total"))
