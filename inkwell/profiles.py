"""Language profiles: the rules by which texts are cut into paragraphs, sentences and words.

JAPANESE states the semantics of the published analysis. LATIN is an extension of it for alphabetic languages: each line
is a paragraph, words are runs of lower-cased letters, and there is no part of speech. LATIN_BLOCKS is LATIN with
paragraphs that end at blank lines, headings, tables and rules, as in JAPANESE.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    name: str
    sentence_end: str
    keeps: str  # a sentence counts if this is found in it
    commas: str
    phrase: str
    token: str
    line_is_paragraph: bool
    analysed: bool  # words, morae and endings need a morphological analyser's tokens


JAPANESE = Profile("ja", "[。！？]", "[ぁ-んァ-ヶ一-龯々〆ヵヶ]", "、，", "ではなく", r"[ぁ-んァ-ヶー一-龯々〆ヵヶA-Za-z0-9]+", False, True)
LATIN = Profile("latin", "[.!?]", "[A-Za-zÀ-ÿ]", ",", " not ", "[a-zà-ÿ]+", True, False)
LATIN_BLOCKS = replace(LATIN, name="latin-blocks", line_is_paragraph=False)

#: Fixed values, which results depend on: Markdown noise of the lexical cleaner (a last alternative for whole table rows
#: is left out, as the bar before it always matches first), the line and inline rules of the structural parser, small kana,
#: parts of speech, closing marks, stop words, limits and the seed.
LEXICAL_NOISE = r"```[\s\S]*?```|`[^`]+`|!\[.*?\]\(.*?\)|\[.*?\]\(.*?\)|#{1,6}\s|[*_~`>|]"
URL = r"https?://\S+"
LIST_ITEM = r"^\s*(?:[-*+]\s+|\d{1,3}[.)]\s+)"
QUOTE = r"^\s*>+\s?"
IMAGE, LINK, INLINE_CODE = r"!\[[^\]]*\]\([^)]*\)", r"\[([^\]]*)\]\([^)]*\)", r"`([^`]*)`"
HTML_TAG = r"</?[a-zA-Z][^>]*>|<!--.*?-->"
SMALL_KANA = "ァィゥェォャュョヮ"
PUNCTUATION_POS = ("補助記号", "記号", "空白")
TRAILING_CLUTTER = tuple("」』）)】＞>”\"'…‥・：:；;、，,")
CONTENT_POS = ("名詞", "動詞", "形容詞", "副詞", "接続詞")
EXCLUDED_NOUNS = ("数詞", "非自立可能", "代名詞", "助数詞")
DEPENDENT = "非自立可能"
NOUN = "名詞"
STOP_WORDS = (
    "する", "為る", "いる", "居る", "ある", "有る", "なる", "成る", "できる", "出来る", "れる", "られる", "こと", "事", "もの", "物", "ため", "為", "よう", "様",
    "それ", "これ", "ここ", "其れ", "此れ", "此処", "の", "に", "は", "を", "が", "と", "で", "も", "か", "や", "へ", "から", "まで", "より", "etc", "##",
)
MIN_CHARS, MIN_SENTENCES, MIN_PARAGRAPHS, MATTR_WINDOW = 100, 5, 3, 20
ALPHA, SEED = 0.05, 20260717
