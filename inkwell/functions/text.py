"""Cleaning, parsing and token expressions. All are row-local: no operator here shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell import profiles as P

_BLANK = r"[^\S\n]*+"  # white space inside a line
_FENCE = rf"(?Umd)^{_BLANK}(?:```|~~~)[^\n]*(?:\n|\z)"
_BOUNDARY = rf"{_BLANK}|{_BLANK}#{{1,6}}[^\S\n]+\S[^\n]*|{_BLANK}\|[^\n]*|{_BLANK}(?:[-*_]{_BLANK}){{3,}}+"


#: The White_Space characters of Unicode, and the separators U+001C to U+001F.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without white space (U+3000 and the separators U+001C to U+001F included) at both ends."""
    return F.btrim(text, F.lit(_SPACES))


def valid(text: Column, drop: bool = False) -> Column:
    """Well-formed text with \\n line ends; invalid bytes become U+FFFD, or go (with genuine U+FFFD) if ``drop``."""
    text = F.regexp_replace(F.make_valid_utf8(text), "\r\n?", "\n")
    return F.translate(text, "�", "") if drop else text


def without_noise(text: Column) -> Column:
    """Markdown noise and URLs to spaces; a text without a character that they begin with is not searched for them."""
    clean = F.when(text.rlike(r"[`\[#*_~>|]"), F.regexp_replace(text, f"(?Ud){P.LEXICAL_NOISE}", " ")).otherwise(text)
    return F.when(F.contains(text, F.lit("://")), F.regexp_replace(clean, f"(?U){P.URL}", " ")).otherwise(clean)


def clean_lexical(text: Column) -> Column:
    """Markdown noise and URLs to single spaces."""
    return strip(F.regexp_replace(without_noise(text), r"(?U)\s+", " "))


def clean_inline(line: Column) -> Column:
    """A line without images, HTML tags, URLs and emphasis; texts of links and inline code stay.

    Only a line with one of the marks that these begin with is searched for them.
    """
    clean = F.regexp_replace(line, P.IMAGE, "")
    clean = F.regexp_replace(F.regexp_replace(clean, P.LINK, "$1"), P.INLINE_CODE, "$1")
    clean = F.regexp_replace(F.regexp_replace(clean, f"(?s){P.HTML_TAG}", ""), f"(?U){P.URL}", "")
    clean = F.replace(F.replace(clean, F.lit("**")), F.lit("__"))
    return strip(F.when(line.rlike(r"[\[`<]|://|\*\*|__"), clean).otherwise(line))


def paragraphs(text: Column, profile: P.Profile) -> Column:
    """array<array<struct<text, is_list>>>: sentences by paragraph, without code fences, headings, tables and rules.

    Text between fence lines goes, to the end if a fence stays open; a fence doesn't end a paragraph. Lists are told
    before quote marks go. Paragraphs without a kept sentence don't count. Null gives null.
    """
    pieces = F.filter(F.split(text, _FENCE, -1), lambda _, i: i % 2 == 0)
    body = F.array_join(pieces, "")
    if profile.line_is_paragraph:
        blocks = F.filter(F.split(body, "\n", -1), lambda line: ~line.rlike(rf"(?Ud)^(?:{_BOUNDARY})$"))
    else:
        blocks = F.split(body, rf"(?Umd)(?:^(?:{_BOUNDARY})(?:\n|\z))++", -1)

    # each step is made once for a line: what a lambda's argument stands for is not made again where it is used twice
    def told(line: Column) -> Column:
        return F.struct(line.alias("line"), line.rlike(f"(?U){P.LIST_ITEM}").alias("is_list"))

    def unmarked(x: Column) -> Column:
        item = F.when(x["is_list"], F.regexp_replace(x["line"], f"(?U){P.LIST_ITEM}", "")).otherwise(x["line"])
        return F.struct(F.when(F.contains(x["line"], F.lit(">")), F.regexp_replace(item, f"(?U){P.QUOTE}", "")).otherwise(item).alias("line"), x["is_list"].alias("is_list"))

    def sentences(x: Column) -> Column:
        every = F.transform(F.split(clean_inline(x["line"]), profile.sentence_end, -1), lambda s: F.struct(strip(s).alias("text"), x["is_list"].alias("is_list")))
        return F.filter(every, lambda s: s["text"].rlike(profile.keeps))

    by_line = lambda lines: F.transform(F.transform(F.transform(lines, told), unmarked), sentences)
    kept = by_line(blocks) if profile.line_is_paragraph else F.transform(blocks, lambda b: F.flatten(by_line(F.split(b, "\n", -1))))
    return F.filter(kept, lambda p: F.size(p) > 0)


def words(text: Column, profile: P.Profile) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(profile.token), F.lit(0))


def last_bigram(tokens: Column) -> Column:
    """The last two of an array joined by a bar (one if there is only one)."""
    return F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - 1, F.lit(1)), F.lit(2)), "|")


TOKEN = "struct<surface:string,pos1:string,pos2:string,lemma:string,pron:string>"
#: A morphological analyser: a text's tokens as (surface, pos1, pos2, lemma, pron), each but the first may be None.
Analyser = Callable[[str], Iterable[tuple]]


def analysed(texts: Column, analyse: Analyser) -> Column:
    """array<string> -> array<array<TOKEN>> by a pluggable analyser, in Arrow batches; nulls have no tokens."""
    run = F.udf(lambda every: [[tuple(t) for t in analyse(x)] if x is not None else [] for x in every or []], f"array<array<{TOKEN}>>", useArrow=True)
    return run(texts)


def endings(tokens: Column) -> Column:
    """"surface/pos1" of each of an array of tokens, as sentence endings are told apart."""
    return F.transform(tokens, lambda t: F.concat_ws("/", t["surface"], F.coalesce(t["pos1"], F.lit(""))))


def content_words(tokens: Column) -> Column:
    """Lemmas of content words of array<struct<surface, pos1, pos2, lemma, pron>>; the surface where no lemma is known."""
    lemma = lambda t: F.coalesce(F.nullif(F.nullif(t["lemma"], F.lit("*")), F.lit("")), t["surface"])
    stop = F.array(*map(F.lit, P.STOP_WORDS))

    def counts(t: Column) -> Column:
        noun_out = (t["pos1"] == P.NOUN) & F.coalesce(t["pos2"], F.lit("")).isin(*P.EXCLUDED_NOUNS)
        verb_out = (t["pos1"] == "動詞") & (F.coalesce(t["pos2"], F.lit("")) == P.DEPENDENT)
        short = (F.length(lemma(t)) == 1) & ~lemma(t).rlike(r"^\p{L}$")
        return t["pos1"].isin(*P.CONTENT_POS) & ~noun_out & ~verb_out & ~F.array_contains(stop, lemma(t)) & ~F.array_contains(stop, t["surface"]) & ~short

    return F.transform(F.filter(tokens, counts), lemma)


def content_morphemes(tokens: Column) -> Column:
    """Tokens other than punctuation and closing marks."""
    return F.filter(tokens, lambda t: ~F.coalesce(t["pos1"].isin(*P.PUNCTUATION_POS), F.lit(False)) & ~t["surface"].isin(*P.TRAILING_CLUTTER))


def morae(tokens: Column) -> Column:
    """Characters of the readings but for small kana; punctuation and words without a reading count 0."""
    sounded = F.filter(tokens, lambda t: ~F.coalesce(t["pos1"].isin(*P.PUNCTUATION_POS), F.lit(False)) & (F.coalesce(t["pron"], F.lit("*")) != "*"))
    return F.aggregate(sounded, F.lit(0), lambda n, t: n + F.length(F.regexp_replace(t["pron"], f"[{P.SMALL_KANA}]", "")))


def syllables(text: Column) -> Column:
    """LATIN's stand-in for morae: runs of vowels."""
    return F.regexp_count(F.lower(text), F.lit("[aeiouyà-æè-ïò-öù-ÿ]+"))
