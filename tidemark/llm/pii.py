"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Protected entities are the values that the base patterns find (e-mail, IP address, card and phone number), secrets (literals
of letters and digits whose characters carry `SECRET_BITS` or more), and what is known by their parts: an e-mail's account
and host, an address's network, and the class of such values as a whole. A term is a word near such a value, and what
holds of it there holds of every place of that word in a document with the value. Over the whole corpus, a term's
disclosure of an entity is its pointwise mutual information with the entity as a share of the entity's own information:

    disclosure = ln(N n_et / (n_e n_t)) / ln(N / n_e)

where N counts documents, n_e and n_t those that hold the entity and the term, n_et those with the term near the entity. A
term that at least `SUPPORT` different texts put near the entity (fewer are chance) is generalised from `GENERALISE` on and removed from
`REMOVE` on. Lacking a taxonomy, generalising means putting the class of the term, [WORD], in its place.

All of it is DataFrame functions. Null and empty texts have no spans; repeated rows are answered each; offsets count code
points, ends exclusive. Null doc_ids are kept. An empty table gives no rows. Extra columns stay in `sanitise`, and are not
read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stored

SUPPORT, GENERALISE, REMOVE = 3, 0.75, 0.95
#: Characters on either side of an entity in which terms are sought, and the least length of a term.
REACH, TERM = 48, 3
KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: Of KINDS, those of the base patterns; the number of the last.
BASE, TERM_KIND = 4, 5
#: Bits of information in the characters of a literal of letters and digits from which on it is a secret.
SECRET_BITS = 72.0
#: kind: (what a text must hold, the pattern). Possessive quantifiers and look-behinds keep them linear on long runs and leave the leftmost matches as they are.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?+[0-9]){12,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (r"[A-Za-z0-9_-]{20}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"),
}
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
_MENTIONS = "array<struct<entity:string,term:string,start:int,end:int>>"


def _matches(text: Column, pattern: str | Column, kind: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<kind,start,end,value>>: what stands between them gives their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit([]).cast(_SPAN).alias("out"))
    return F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), begin, step, lambda done: done["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0)


def _secret(value: Column) -> Column:
    """A literal with four letters and four digits at least whose characters carry SECRET_BITS: length times entropy."""
    chars = F.split(value, "")
    n = F.size(chars)
    own = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t + F.size(F.filter(chars, lambda x: x == c)) * F.log2(F.size(F.filter(chars, lambda x: x == c)).cast("double")))
    return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4) & (n * F.log2(n.cast("double")) - own >= SECRET_BITS)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "secret": _secret,
}


def _spans(text: Column, kinds: range) -> Column:
    found = []
    for k in kinds:
        guard, pattern = PATTERNS[KINDS[k]]
        valid = _VALID[KINDS[k]]
        hits = F.filter(_matches(text, pattern, k), lambda s: valid(s["value"]))
        found.append(F.when(text.rlike(guard), hits).otherwise(F.lit([]).cast(_SPAN)))
    return F.concat(*found)


def base_spans(text: Column) -> Column:
    """Base findings of a text by kind as listed, then start."""
    return _spans(text, range(BASE))


def _entities(span: Column) -> Column:
    """What a finding protects: its value, what is known by its parts (an e-mail's account and host, a network), and its class."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1)
    named = lambda part, value: F.concat(kind, F.lit(f"{part}:"), value)
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"].isin(2, 3), _digits(span["value"])).otherwise(span["value"])
    parts = F.when(span["kind"] == 0, F.array(named(" account", F.substring_index(value, "@", 1)), named(" host", F.substring_index(value, "@", -1)))).when(span["kind"] == 1, F.array(named(" network", F.substring_index(value, ".", 3)))).otherwise(F.lit([]).cast("array<string>"))
    return F.concat(F.array(named("", value)), parts, F.array(kind))


def _all_entities(spans: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, _entities)))


def _mentions(text: Column, spans: Column) -> Column:
    """Terms near each entity; a word that the reach cuts is left out, as is one inside a base span."""

    def near(span: Column) -> Column:
        low = F.greatest(span["start"] - REACH, F.lit(0))
        before = _matches(F.substring(text, low + 1, span["start"] - low), r"\p{L}+", TERM_KIND)
        after = _matches(F.substring(text, span["end"] + 1, F.lit(REACH)), r"\p{L}+", TERM_KIND)
        before = F.filter(before, lambda t: (t["start"] > 0) | (low == 0))
        after = F.filter(after, lambda t: (t["end"] < REACH) & (t["start"] > 0))
        both = F.concat(
            F.transform(before, lambda t: F.struct(F.lower(t["value"]).alias("term"), (t["start"] + low).alias("start"), (t["end"] + low).alias("end"))),
            F.transform(after, lambda t: F.struct(F.lower(t["value"]).alias("term"), (t["start"] + span["end"]).alias("start"), (t["end"] + span["end"]).alias("end"))),
        )
        both = F.filter(both, lambda t: (F.length(t["term"]) >= TERM) & ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
        return F.flatten(F.transform(_entities(span), lambda e: F.transform(both, lambda t: F.struct(e.alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["end"].alias("end")))))

    return F.when(F.size(spans) > 0, F.flatten(F.transform(spans, near))).otherwise(F.lit([]).cast(_MENTIONS))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def _everywhere(found: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end, disclosure: all places of each telling term in the documents that hold its entity, outside base spans."""
    holds = found.where(F.size("spans") > 0)
    words = holds.select("doc_id", "text_key", _all_entities(F.col("spans")).alias("entities"), F.explode(_terms(F.col("held"))).alias("term"))
    words = words.join(telling.select("term").distinct(), "term", "left_semi").select("doc_id", "text_key", "term", F.explode("entities").alias("entity"))
    told = words.join(telling, ["entity", "term"]).groupBy("doc_id", "text_key", "term").agg(F.max("disclosure").alias("disclosure"))
    told = told.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_list(F.struct("term", "disclosure")).alias("told"))
    same = holds["doc_id"].eqNullSafe(told["d"]) & (holds["text_key"] == told["k"])
    each = holds.join(told, same).select("doc_id", "text_key", "spans", "held", F.explode("told").alias("t"))
    # a term is letters only, so that it stands for itself in a pattern
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.col("t.term"), F.lit(r"(?!\p{L})"))
    places = F.filter(_matches(F.col("held"), pattern, TERM_KIND), lambda p: ~F.exists("spans", lambda s: (s["start"] < p["end"]) & (p["start"] < s["end"])))
    return each.select("doc_id", "text_key", F.explode(places).alias("p"), "t.disclosure").select("doc_id", "text_key", "p.start", "p.end", "disclosure")


def disclosures(found: DataFrame, texts: DataFrame) -> DataFrame:
    """entity, term, disclosure of all pairs that reach SUPPORT and GENERALISE. found: spans and mentions by document; texts: the documents' text."""
    n_docs = found.agg(F.count("*").alias("n_docs"))
    per_entity = found.where(F.size("spans") > 0).select(F.explode(_all_entities(F.col("spans"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    pair = F.array_distinct(F.transform("mentions", lambda m: F.struct(m["entity"].alias("entity"), m["term"].alias("term"))))
    pairs = found.where(F.size("mentions") > 0).select("text_key", F.explode(pair).alias("pair")).groupBy("pair", "text_key").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n_et"), F.count("*").alias("n_texts"))
    pairs = stored(pairs.where(F.col("n_texts") >= SUPPORT).select("pair.entity", "pair.term", "n_et"))
    per_term = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    known = pairs.join(per_term, "term").join(per_entity, "entity").crossJoin(F.broadcast(n_docs))  # n_docs is one row
    share = F.log(F.col("n_docs") * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.col("n_docs") / F.col("n_e"))
    return known.where("n_e < n_docs").select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: key, text_key, spans array<struct<kind,start,end,value>> (base), secrets (likewise), terms array<struct<start,end,disclosure>>."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base, secrets = base_spans(F.col("text")), _spans(F.col("text"), range(BASE, TERM_KIND))
    spans = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text", base.alias("base"), secrets.alias("secrets"))
    apart = F.filter("secrets", lambda x: ~F.exists("base", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    spans = spans.select("doc_id", "text_key", "text", F.concat("base", apart).alias("spans"))
    held = F.when(F.size("spans") > 0, F.col("text")).alias("held")
    found = stored(spans.select("doc_id", "text_key", "spans", held, _mentions(F.col("text"), F.col("spans")).alias("mentions")))
    telling = stored(disclosures(found, rows))
    placed = found.where(F.size("mentions") > 0).select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    near = placed.join(telling, ["entity", "term"]).select("doc_id", "text_key", "start", "end", "disclosure")
    terms = near.unionByName(_everywhere(found, telling)).groupBy("doc_id", "text_key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = terms.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    same = found["doc_id"].eqNullSafe(terms["d"]) & (found["text_key"] == terms["k"])
    own, secrets = F.filter("spans", lambda s: s["kind"] < BASE), F.filter("spans", lambda s: s["kind"] >= BASE)
    return found.join(terms, same, "left").select("doc_id", "text_key", own.alias("spans"), secrets.alias("secrets"), F.coalesce("terms", F.lit([]).cast("array<struct<start:int,end:int,disclosure:double>>")).alias("terms"))


def sanitise(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with [EMAIL], [IP], [CARD], [PHONE] and [SECRET] in place of entities, [WORD] in place of generalised terms, and without removed ones. Null text stays null."""
    found = findings(docs, text, key)
    marks = F.concat(
        F.transform(F.concat("spans", "secrets"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"] + 1).alias("mark"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= REMOVE, F.lit("")).otherwise(F.lit("[WORD]")).alias("mark"))),
    )
    marks = found.where(F.size("spans") + F.size("secrets") + F.size("terms") > 0).select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.array_sort(marks).alias("__marks")).dropDuplicates(["__d", "__k"])
    body = F.col(f"`{text}`")

    def step(done: Column, m: Column) -> Column:
        new = m["start"] >= done["at"]
        piece = F.concat(F.substring(body, done["at"] + 1, m["start"] - done["at"]), m["mark"])
        return F.struct(F.greatest(done["at"], m["end"]).alias("at"), F.when(new, F.concat(done["out"], F.array(piece))).otherwise(done["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("out"))
    clean = F.aggregate("__marks", begin, step, lambda done: F.concat(F.array_join(done["out"], ""), F.substring(body, done["at"] + 1, F.length(body))))
    joined = docs.join(marks, docs[key].eqNullSafe(marks["__d"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == marks["__k"]), "left")
    return joined.select(*(F.when(F.col("__marks").isNotNull(), clean).otherwise(body).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
