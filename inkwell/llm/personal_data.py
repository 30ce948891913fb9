"""Personal data by weak supervision, in DataFrame operations only.

Spans that the fixed patterns prove (BASE) always count. Wider patterns give further candidates of each kind: spelled-out
addresses, numbers with other separators, masked parts, digits as words. On all candidates labelers vote for (1), against
(-1) or not at all (0): the usual shape of the normal form, a gazetteer, cue words in the context before, and the proof of
the base pattern. The gazetteer holds known beginnings and endings, and the domains, networks, issuers and areas that
proven spans of the corpus share: the GAZETTEER commonest go to all tasks, the others are joined by key. Expectation-maximisation over the table of vote patterns
estimates each labeler's reliability; its posteriors, of all candidates, are the soft labels from which a final span
classifier, naive Bayes on votes, digits and separators, is trained. Candidates are counted where they stand; only bounded
tables come to the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import free_name, keep, new_folder

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that each run of characters is tried from one start only; the matches are the same.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_WORDS = "|".join(_NUMBERS)
#: Wider patterns. Email: "at" or "dot" written out. IP: other dots, masked parts, version 6. Card: masked groups, other
#: separators. Phone: grouped numbers without a plus sign, digits as words.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:(?: ?[\[(]at[\])] ?|＠)[a-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[a-z0-9-]++)++| at [a-z0-9-]++(?:(?: dot | ?[\[(]dot[\])] ?)[a-z0-9-]++)++)",
    "ip": r"(?i)(?<![0-9a-z.:])(?:[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}+){3}|(?:[0-9]{1,3}+\.){2}(?:[0-9]{1,3}+|[x*]{1,3}+)\.[x*]{1,3}+|(?:[0-9a-f]{1,4}+:){4,7}[0-9a-f]{1,4}+)(?![0-9a-z:])",
    "card": r"(?i)(?<![0-9a-z*])(?:(?:[0-9]{4}|[x*•]{4})(?:[ -]?[x*•]{4}){1,2}[ -]?[0-9]{4}|[0-9]{4}(?:[._/][0-9]{4}){3})(?![0-9a-z])",
    "phone": rf"(?i)(?<![0-9A-Za-z+.])\(?[0-9]{{2,4}}+\)?(?:[ .-][0-9]{{2,4}}+){{2,4}}+(?![0-9A-Za-z])|\b(?:{_WORDS})(?:[ -](?:{_WORDS})){{6,14}}\b",
}
_LIKELY = rf"(?i)[0-9@＠]|[\[(]at[\])]| at [a-z0-9-]+ dot |(?:{_WORDS})[ -](?:{_WORDS})[ -](?:{_WORDS})"
#: Fixed values of the labelers: the usual shape of a normal form, known beginnings or endings, and cue words before a span.
SHAPES = {"email": r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$", "ip": r"^(?:[0-9]{1,3}\.){2}[0-9x*]{1,3}\.[0-9x*]{1,3}$|^[0-9a-f:]+$", "card": r"^(?:[0-9]{14,19}|[0-9x*•]{4}(?:[ -]?[0-9x*•]{4}){2,3})$", "phone": r"^(?:\+[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$|^(?:[0-9]{7}|[0-9]{10,11})$"}
KNOWN = {"email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$", "ip": r"^(?:10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)", "card": r"^(?:3[47]|4|5[1-5]|6011|65)", "phone": r"^\+(?:1|33|34|44|49)|^\(?(?:555|800|888)"}
CUES = {"email": r"(?i)(?:e-?mail|contact|write to|mailto)[^0-9@]{0,24}$", "ip": r"(?i)(?:\bip\b|server|host|address)[^0-9@]{0,24}$", "card": r"(?i)(?:card|visa|credit|payment)[^0-9@]{0,24}$", "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell)[^0-9@]{0,24}$"}
AGAINST = r"(?i)(?:isbn|issn|order|invoice|version|\bv|date|page|\bid|no\.?|#)[^0-9@]{0,6}$"
CONTEXT = 40
ROUNDS = 25
ACCEPT = 0.85
WEIGHT = 4.0
GAZETTEER = 4096  # keys that proven spans share and all tasks hold; there is no bound on the others


def _located(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, start, end, text>> of all matches, in code points; what lies between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,text:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        at = state["at"] + F.length(pair["gap"])
        end = at + F.length(pair["hit"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), at.alias("start"), end.alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(F.zip_with(between, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), start, add)["spans"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _proven(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(text, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Proven spans of all kinds, ordered by start, then kind."""

    def proven(kind: str) -> Column:
        return F.filter(_located(text, kind, BASE[kind]), lambda s: _proven(kind, s["text"]))

    return _ordered(F.concat(*map(proven, KINDS)))


def _ordered(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def _by_kind(kind: Column, make, other: Column | None = None) -> Column:
    out = F.lit(0) if other is None else other
    for i, name in enumerate(KINDS):
        out = F.when(kind == i, make(name)).otherwise(out)
    return out


def _normal(kind: str, hit: Column) -> Column:
    """The usual writing of a candidate: lower case, with signs and digits for words."""
    hit = F.lower(hit)
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(hit, r" ?[\[(]at[\])] ?| at |＠", "@"), r" ?[\[(]dot[\])] ?| dot ", ".")
    if kind == "ip":
        return F.regexp_replace(hit, r"\[\.\]|\(\.\)| dot ", ".")
    if kind == "card":
        return F.regexp_replace(hit, "[._/]", " ")
    spelled = F.regexp_replace(hit, "[ -]", "")
    for i, word in enumerate(_NUMBERS):
        spelled = F.regexp_replace(spelled, word, str(i))
    return F.when(hit.rlike("[a-z]"), spelled).otherwise(hit)


def _key(kind: str, normal: Column) -> Column:
    """What spans of one owner share: domain, network, issuer, or country and area."""
    if kind == "email":
        return F.substring_index(normal, "@", -1)
    if kind == "ip":
        return F.substring_index(normal, ".", 2)
    return F.substring(F.ltrim(_digits(normal), F.lit("0")), 1, 4)


def candidate(span: Column, text: Column, proven: bool) -> Column:
    """A span with the labelers' votes and the classifier's features."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, begin + 1, span["start"] - begin)

    def told(normal: Column) -> Column:
        shape = _by_kind(span["kind"], lambda k: F.when(normal.rlike(SHAPES[k]), 1).otherwise(-1))
        known = _by_kind(span["kind"], lambda k: F.when(normal.rlike(KNOWN[k]), 1).otherwise(0))
        cue = _by_kind(span["kind"], lambda k: F.when(before.rlike(CUES[k]), 1).when(before.rlike(AGAINST), -1).otherwise(0))
        digits, marks = F.least(F.length(_digits(normal)), F.lit(20)), F.least(F.length(F.regexp_replace(normal, "[0-9a-z]", "")), F.lit(6))
        key = F.concat(span["kind"].cast("string"), F.lit(":"), _by_kind(span["kind"], lambda k: _key(k, normal), F.lit("")))
        return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(proven).alias("proven"), shape.alias("shape"), known.alias("known"), cue.alias("cue"), (digits / 3).cast("int").alias("digits"), marks.alias("marks"), key.alias("key"))

    return F.get(F.transform(F.array(_by_kind(span["kind"], lambda k: _normal(k, span["text"]), F.lit(""))), told), F.lit(0))


def candidates(text: Column) -> Column:
    """Proven spans, and wider ones that overlap none of them."""
    base = base_spans(text)

    def wider(base: Column) -> Column:
        some = F.concat(*[_located(text, kind, WIDE[kind]) for kind in WIDE])
        likely = F.filter(some, lambda s: (s["kind"] != KINDS.index("phone")) | s["text"].rlike("[A-Za-z]") | F.length(_digits(s["text"])).between(9, 15))
        free = F.filter(likely, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.concat(F.transform(base, lambda s: candidate(s, text, True)), F.transform(free, lambda s: candidate(s, text, False)))

    return F.get(F.transform(F.array(base), wider), F.lit(0))


VOTES = ("shape", "known", "cue", "proof")
FEATURES = ("shape", "known", "cue", "digits", "marks")  # a wider candidate has no proof, so it isn't among them
#: What EM starts from: P(vote | true), P(vote | false).
_CHANCES = {v: {1: (0.7, 0.15), 0: (0.2, 0.35), -1: (0.1, 0.5)} for v in VOTES} | {"proof": {1: (0.6, 0.05), 0: (0.4, 0.95), -1: (0.5, 0.5)}}


def reliabilities(table: list[tuple[tuple[int, ...], float]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM on (votes, number): the share of true spans, and for each labeler P(vote | true), P(vote | false)."""
    share = 0.5
    chance = [dict(_CHANCES[v]) for v in VOTES]
    for _ in range(ROUNDS):
        sums = [defaultdict(lambda: [0.5, 0.5]) for _ in VOTES]
        yes = no = 1.0
        for votes, n in table:
            p = posterior(share, chance, votes)
            yes, no = yes + n * p, no + n * (1 - p)
            for k, v in enumerate(votes):
                sums[k][v][0] += n * p
                sums[k][v][1] += n * (1 - p)
        share = yes / (yes + no)
        chance = [{v: ((sums[k][v][0]) / (yes + 0.5), (sums[k][v][1]) / (no + 0.5)) for v in (1, 0, -1)} for k in range(len(VOTES))]
    return share, chance


def posterior(share: float, chance: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(chance[k][v][0] / chance[k][v][1]) for k, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(min(odds, 30.0), -30.0)))


def _votes(row) -> tuple[int, ...]:
    return (row["shape"], row["known"], row["cue"], int(row["proven"]))


def classifier(counts: list) -> dict[str, float]:
    """Naive Bayes log odds by "kind/feature/value" (and "kind" alone), from the soft labels of EM on the same counts.

    A value's chances in both classes are drawn towards its chance in all candidates by WEIGHT of these, so a value that
    tells nothing counts nothing.
    """
    soft: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for kind in range(len(KINDS)):
        own = [r for r in counts if r["kind"] == kind]
        votes: dict[tuple[int, ...], float] = defaultdict(float)
        for r in own:
            votes[_votes(r)] += r["count"]
        share, chance = reliabilities(sorted(votes.items()))
        for r in own:
            p = posterior(share, chance, _votes(r))
            for key in ((kind,), *((kind, f, r[f]) for f in FEATURES)):
                soft[key][0] += r["count"] * p
                soft[key][1] += r["count"] * (1 - p)
    out = {}
    for key, (yes, no) in soft.items():
        all_yes, all_no = soft[key[:1]]
        if len(key) == 1:
            out[str(key[0])] = math.log((yes + 1) / (no + 1))
        else:
            usual = WEIGHT * (yes + no) / (all_yes + all_no)
            out["/".join(map(str, key))] = math.log((yes + usual) / (all_yes + WEIGHT)) - math.log((no + usual) / (all_no + WEIGHT))
    return out


def _log_odds(span: Column, weights: Column) -> Column:
    kind = span["kind"].cast("string")
    total = F.coalesce(weights[kind], F.lit(0.0))
    for f in FEATURES:
        total = total + F.coalesce(weights[F.concat_ws("/", kind, F.lit(f), span[f].cast("string"))], F.lit(0.0))
    return total


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _spotted(column: Column) -> Column:
    text = F.coalesce(column, F.lit(""))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,proven:boolean,shape:int,known:int,cue:int,digits:int,marks:int,key:string>>")
    return F.when(text.rlike(_LIKELY), candidates(text)).otherwise(none)


def _gazetteer(seen: DataFrame) -> tuple[Column, DataFrame | None]:
    """Keys that two or more proven spans of the column held share.

    The GAZETTEER commonest come as a literal array. Of the others, if there are any, (mark, more) gives those that the
    spans of a mark have.
    """
    keys = seen.select(F.explode(F.filter("held", lambda s: s["proven"] & ~s["key"].endswith(":"))).alias("s")).groupBy("s.key").count().where("count > 1")
    found = keys.orderBy(F.desc("count"), "key").limit(GAZETTEER + 1).collect()
    common = F.split(F.lit("\n".join(sorted(r["key"] for r in found[:GAZETTEER]))), "\n")
    if len(found) <= GAZETTEER:
        return common, None
    last = found[GAZETTEER - 1]
    rest = keys.where((F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("key") > last["key"]))).select("key")
    asked = seen.select("mark", F.explode(F.filter("held", lambda s: (s["known"] == 0) & ~F.array_contains(common, s["key"]))).alias("s")).select("mark", "s.key").distinct()
    folder = new_folder(seen.sparkSession, "gazetteer")
    asked.join(rest, "key", "left_semi").groupBy("mark").agg(F.collect_set("key").alias("more")).write.parquet(folder)
    return common, seen.sparkSession.read.schema(f"mark {seen.schema['mark'].dataType.simpleString()}, more array<string>").parquet(folder)


def _with_more(rows: DataFrame, told: DataFrame | None, mark: str = "mark", more: str = "more") -> DataFrame:
    """Rows with the rarer keys of the gazetteer that their spans have (null: none)."""
    if told is None:
        return rows.withColumn(more, F.lit(None).cast("array<string>"))
    return rows.join(told.select(F.col("mark").alias(mark), F.col("more").alias(more)), mark, "left")


def _voted(held: Column, gazetteer: Column, more: Column) -> Column:
    """Candidates with the gazetteer's votes."""
    known = lambda s: F.when(F.array_contains(gazetteer, s["key"]) | F.coalesce(F.array_contains(more, s["key"]), F.lit(False)), 1).otherwise(s["known"]).alias("known")
    return F.transform(held, lambda s: F.struct(*(known(s) if f == "known" else s[f].alias(f) for f in ("kind", "start", "end", "proven", "shape", "known", "cue", "digits", "marks"))))


def _trained(seen: DataFrame) -> tuple[Column, DataFrame | None, Column]:
    """The gazetteer, its rarer keys by mark, and the classifier, a literal map, for the candidates in the column held.

    Rows that share a mark have the same candidates.
    """
    gazetteer, told = _gazetteer(seen)
    rows = _with_more(seen.where(F.size("held") > 0), told).select(F.explode(_voted(F.col("held"), gazetteer, F.col("more"))).alias("s"))
    counts = rows.select("s.kind", "s.proven", *(f"s.{f}" for f in FEATURES)).groupBy("kind", "proven", *FEATURES).count()
    weights = classifier(sorted(counts.collect()))  # at most kinds x votes x features rows
    return gazetteer, told, F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair)) if weights else F.create_map(F.lit(""), F.lit(0.0))


def _accepted(held: Column, gazetteer: Column, more: Column, weights: Column) -> Column:
    return F.filter(_voted(held, gazetteer, more), lambda s: s["proven"] | (_log_odds(s, weights) >= math.log(ACCEPT / (1 - ACCEPT))))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with each span in ``text`` replaced by its kind in brackets ("[EMAIL]"); other columns stay.

    Of overlapping spans the first is replaced, and what of a later one goes beyond it. A null text stays null.
    """
    gazetteer, told, weights = _trained(keep(docs.select(_spotted(F.col("text")).alias("held"), F.sha2("text", 256).alias("mark")).where(F.size("held") > 0)))
    mark, more = free_name(docs, "_mark"), free_name(docs, "_more")
    if told is not None:  # texts without candidates have marks of their own, so that they don't meet in a task
        docs = docs.withColumn(mark, F.when(F.col("text").rlike(_LIKELY), F.sha2("text", 256)).otherwise(F.monotonically_increasing_id().cast("string")))
    docs = _with_more(docs, told, mark, more)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cleaned(found: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def put(state: Column, s: Column) -> Column:
            start = F.greatest(s["start"], state["at"])
            more = F.array(F.substring(F.col("text"), state["at"] + 1, start - state["at"]), F.get(names, s["kind"]))
            return F.when(s["end"] <= state["at"], state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["parts"], more).alias("parts")))

        def close(state: Column) -> Column:
            rest = F.substring(F.col("text"), state["at"] + 1, F.length("text"))
            return F.array_join(F.concat(state["parts"], F.array(rest)), "")

        return F.aggregate(found, begin, put, close)

    accepted = _accepted(_spotted(F.col("text")), gazetteer, F.col(more), weights)
    some = F.get(F.transform(F.array(_ordered_spans(accepted)), lambda found: F.when(F.size(found) > 0, cleaned(found)).otherwise(F.col("text"))), F.lit(0))
    return docs.withColumn("text", F.when(F.col("text").rlike(_LIKELY), some).otherwise(F.col("text"))).drop(mark, more)


def _ordered_spans(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """Personal data in whole texts (doc_id, text), one row for each input row, in the order of a scan unless keys beyond
    the GAZETTEER commonest are joined.

    Returns doc_id, n_email, n_ip, n_card, n_phone (proven spans), base_sha256, spans (all spans as kind:start:end, by
    start and kind; code points, end exclusive) and found, the same as array<struct<kind, start, end>>. A null text is
    the empty one and has no span. Rows that repeat are searched each; other columns are ignored; an empty table gives
    an empty result. Added spans are candidates to which the classifier gives ACCEPT or more.
    """
    seen = keep(docs.select("doc_id", F.monotonically_increasing_id().alias("mark"), _spotted(F.col("text")).alias("held")))
    gazetteer, told, weights = _trained(seen)
    accepted = _accepted(F.col("held"), gazetteer, F.col("more"), weights)
    out = _with_more(seen, told).select("doc_id", _ordered_spans(F.filter("held", lambda s: s["proven"])).alias("base"), _ordered_spans(accepted).alias("found"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(number, KINDS), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), "found")
