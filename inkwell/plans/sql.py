"""SQL fragments that state the catalog's results for DuckDB. Word classes are spelled for its regex engine."""

from __future__ import annotations

from inkwell.functions.stats import ERFC, POISSON

MODELS = "('src0','src1','src2','src3','src4','src5','src6')"
#: Fixed values, as in the profiles: Markdown noise and line rules, spelled for this engine.
NOISE = r"```[\s\S]*?```|`[^`]+`|!\[.*?\]\(.*?\)|\[.*?\]\(.*?\)|#{1,6}\s|[*_~`>|]"
LIST_ITEM, QUOTE = r"^\s*(?:[-*+]\s+|\p{Nd}{1,3}[.)]\s+)", r"^\s*>+\s?"
BOUNDARY = r"\s*|\s*#{1,6}\s+\S.*|\s*\|.*|\s*(?:[-*_]\s*){3,}"


def r(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def strip(text: str) -> str:
    return r(text, r"^\s+|\s+$")


def clean_lexical(text: str) -> str:
    return strip(r(r(r(text, NOISE, " "), r"https?://\S+", " "), r"\s+", " "))


def clean_inline(line: str) -> str:
    line = r(r(r(line, r"!\[[^\]]*\]\([^)]*\)"), r"\[([^\]]*)\]\([^)]*\)", r"\1"), "`([^`]*)`", r"\1")
    line = r(r(line, "(?s)</?[a-zA-Z][^>]*>|<!--.*?-->"), r"https?://\S+")
    return strip(f"replace(replace({line}, '**', ''), '__', '')")


def erfc(z: str) -> str:
    t = f"(1/(1+({z})/2))"
    series = repr(ERFC[-1])
    for c in reversed(ERFC[1:-1]):
        series = f"({c!r} + {t}*{series})"
    return f"least(1.0, {t}*exp(-({z})*({z}) + ({ERFC[0]!r}) + {t}*{series}))"


def index(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def poisson(text: str) -> str:
    u = f"({index(text)} / 4294967296.0)"
    return "CASE " + " ".join(f"WHEN {u} < {p!r} THEN {k}" for k, p in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"


def yates(a: str, c: str, n1: str, n0: str) -> str:
    a, c, n1, n0 = (f"({x})::DOUBLE" for x in (a, c, n1, n0))
    b, d = f"({n1}-{a})", f"({n0}-{c})"
    below = f"(({a}+{c})*({b}+{d})*{n1}*{n0})"
    gap = f"greatest(abs({a}*{d}-{b}*{c})-({n1}+{n0})/2, 0)"
    return f"CASE WHEN {below} > 0 THEN ({n1}+{n0})*{gap}*{gap}/{below} END"


WORDS = f"""W AS (SELECT doc_id, source, lang = 'en' AS y, regexp_extract_all(lower({clean_lexical("text")}), '[a-zà-ÿ]+') AS tokens FROM documents),
I AS (SELECT doc_id, source, y, unnest(list_distinct(tokens)) AS word FROM W),
N AS (SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0 FROM W),
F AS (SELECT word, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS c FROM I GROUP BY word HAVING count(*) >= 5)"""
TESTS = f"""{WORDS},
X AS (SELECT word, a, c, {yates("a", "c", "n1", "n0")} AS chi2, (a+1)/(n1+1.0) AS p, (c+1)/(n0+1.0) AS q FROM F, N),
P AS (SELECT *, coalesce({erfc("sqrt(chi2/2)")}, 1.0) AS p_value, count(*) OVER () AS m FROM X),
R AS (SELECT *, row_number() OVER (ORDER BY p_value, word) AS rn FROM P),
Q AS (SELECT *, least(1.0, min(p_value*m/rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_fdr, least(1.0, p_value*m) AS p_bonferroni, p/q AS ratio, p-q AS delta,
  CASE WHEN p/q > 1 THEN 'excess' WHEN p/q < 1 THEN 'deficit' ELSE 'equal' END AS direction FROM R)"""
SENTENCES = f"""L AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
C AS (SELECT doc_id, source, ln, regexp_matches(line, '{LIST_ITEM}') AS is_list, {clean_inline(r(r("line", LIST_ITEM), QUOTE))} AS line FROM L WHERE NOT regexp_full_match(line, '{BOUNDARY}')),
D AS (SELECT doc_id, source, ln, is_list, unnest(string_split_regex(line, '[.!?]')) AS raw, generate_subscripts(string_split_regex(line, '[.!?]'), 1) AS sn FROM C),
S AS (SELECT doc_id, source, dense_rank() OVER (PARTITION BY doc_id ORDER BY ln) AS para_no, row_number() OVER (PARTITION BY doc_id ORDER BY ln, sn) AS sent_no, {strip("raw")} AS text, is_list
  FROM D WHERE regexp_matches(raw, '[A-Za-zÀ-ÿ]'))"""
#: The same with paragraphs that end at blank and boundary lines, of the column ``text`` of a table RAW, without fences.
BLOCKS = f"""L0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM RAW),
L1 AS (SELECT *, regexp_matches(line, '^\\s*(?:```|~~~)') AS fence FROM L0),
L2 AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS fences FROM L1),
L AS (SELECT doc_id, line, ln, regexp_full_match(line, '{BOUNDARY}') AS cut FROM L2 WHERE NOT fence AND fences % 2 = 0),
K AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS block FROM L),
C AS (SELECT doc_id, ln, block, regexp_matches(line, '{LIST_ITEM}') AS is_list, {clean_inline(r(r("line", LIST_ITEM), QUOTE))} AS line FROM K WHERE NOT cut),
D AS (SELECT doc_id, ln, block, is_list, unnest(string_split_regex(line, '[.!?]')) AS raw, generate_subscripts(string_split_regex(line, '[.!?]'), 1) AS sn FROM C),
S AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block) AS para_no, row_number() OVER (PARTITION BY doc_id ORDER BY ln, sn) AS sent_no, {strip("raw")} AS text, is_list FROM D WHERE regexp_matches(raw, '[A-Za-zÀ-ÿ]'))"""
METRICS = f"""{SENTENCES},
T AS (SELECT *, length(replace(text, ' ', '')) AS ch, len(regexp_extract_all(lower(text), '[aeiouyà-æè-ïò-öù-ÿ]+')) AS mo, length(text) - length(replace(text, ',', '')) AS co, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS tokens FROM S),
A AS (SELECT doc_id, max(para_no) AS n_paragraphs, count(*) AS n_sentences, count(*) FILTER (NOT is_list) AS n_prose, avg(ch) AS mc, stddev_pop(ch) AS sc, avg(mo) AS mm, stddev_pop(mo) AS sm, sum(co) AS commas, string_agg(text, '' ORDER BY sent_no) AS joined,
  coalesce(list(array_to_string(tokens[greatest(len(tokens)-1, 1):len(tokens)], '|') ORDER BY sent_no) FILTER (NOT is_list AND len(tokens) > 0), []) AS e FROM T GROUP BY doc_id),
B AS (SELECT doc_id, stddev_pop(k)/avg(k) AS pcv FROM (SELECT doc_id, para_no, count(*) AS k FROM S GROUP BY ALL) GROUP BY doc_id),
Z AS (SELECT d.doc_id, d.source, d.source IN {MODELS} AS ai, coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_prose, 0) AS n_sentences_prose, coalesce(n_sentences, 0) >= 5 AS ok,
  mc, sc, mm, sm, pcv, commas, joined, coalesce(e, []) AS e, len(coalesce(e, [])) AS ne FROM documents d LEFT JOIN A USING (doc_id) LEFT JOIN B USING (doc_id)),
M AS (SELECT doc_id, source, ai, n_paragraphs, n_sentences, n_sentences_prose, ok::INT AS included, ne AS n_endings,
  CASE WHEN ok THEN mc END AS sent_len_char_mean, CASE WHEN ok THEN sc END AS sent_len_char_sd, CASE WHEN ok THEN sc/nullif(mc, 0) END AS sent_len_char_cv,
  CASE WHEN ok THEN mm END AS sent_len_mora_mean, CASE WHEN ok THEN sm END AS sent_len_mora_sd, CASE WHEN ok THEN sm/nullif(mm, 0) END AS sent_len_mora_cv,
  CASE WHEN ok THEN (sc-mc)/nullif(sc+mc, 0) END AS burstiness_char, CASE WHEN ok THEN (sm-mm)/nullif(sm+mm, 0) END AS burstiness_mora,
  CASE WHEN ok AND n_paragraphs >= 3 THEN pcv END AS para_sent_cv, CASE WHEN ok THEN commas/n_sentences END AS comma_per_sentence,
  CASE WHEN ok THEN (length(joined)-length(replace(joined, ' not ', '')))/5/n_sentences END AS phrase_per_sentence,
  CASE WHEN ok AND n_sentences_prose >= 5 AND ne > 0 THEN len(list_distinct(e))/ne END AS ending_bigram_ttr,
  CASE WHEN ne > 20 THEN list_avg(list_transform(range(1, ne-18), lambda i: len(list_distinct(e[i:i+19]))/20)) WHEN ne >= 5 THEN len(list_distinct(e))/ne END AS mattr20,
  CASE WHEN ne >= 5 THEN least(ne, 20) END AS window_used FROM Z)"""
NAMES = (
    "sent_len_char_mean", "sent_len_char_sd", "sent_len_char_cv", "sent_len_mora_mean", "sent_len_mora_sd", "sent_len_mora_cv", "burstiness_char", "burstiness_mora",
    "para_sent_cv", "comma_per_sentence", "phrase_per_sentence", "ending_bigram_ttr", "mattr20",
)
LONG = f"""{METRICS}, V AS ({" UNION ALL ".join(f"SELECT doc_id, source, ai, '{n}' AS metric, round({n}, 6) AS value FROM M WHERE {n} IS NOT NULL" for n in NAMES)})"""


def cohens_d(n1: str, m1: str, v1: str, n0: str, m0: str, v0: str) -> str:
    return f"({m1}-{m0})/nullif(sqrt((({n1}-1)*{v1}+({n0}-1)*{v0})/nullif({n1}+{n0}-2, 0)), 0)"


def mann_whitney(rows: str, group: str, keys: str) -> str:
    """U tests by keys over (keys, value, group)."""
    p = erfc("(greatest(abs(r1 - n1*(n1+1)/2 - n1*n0/2) - 0.5, 0) / nullif(sqrt(n1*n0/12.0*((n1+n0+1) - ties/((n1+n0)*(n1+n0-1.0)))), 0)) / sqrt(2.0)")
    return f"""SELECT {keys}, n1, n0, r1 - n1*(n1+1)/2 AS u, coalesce({p}, 1.0) AS p_value, 2*(r1 - n1*(n1+1)/2)/(n1*n0) - 1 AS rank_biserial FROM (
  SELECT {keys}, count(*) FILTER ({group}) AS n1, count(*) FILTER (NOT {group}) AS n0, sum(rk) FILTER ({group}) AS r1, sum(t*t - 1.0) AS ties FROM (
    SELECT {keys}, {group}, t, rank() OVER (PARTITION BY {keys} ORDER BY value) + (t-1)/2 AS rk FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, value) AS t FROM {rows})) GROUP BY {keys}) WHERE n1 > 0 AND n0 > 0"""
