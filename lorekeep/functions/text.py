"""Column expressions over text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "and", "or", "but", "not", "do", "does", "did",
    "have", "has", "had", "what", "when", "where", "who", "whom", "why", "how", "which", "that", "this", "these", "those", "it", "its", "they", "them", "their", "i", "me", "my", "you", "your",
    "we", "us", "our", "would", "could", "should", "will", "shall", "may", "might", "can", "go", "goes", "went", "going", "gone",
]
# Words that name no entity.
ENTITY_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have",
    "has", "had", "this", "that", "these", "those", "it", "its", "they", "them", "i", "me", "my", "you", "your", "we", "us", "our", "would", "could", "should", "will", "shall", "may", "might",
    "can",
]
# Endings of file names.
FILE_ENDINGS = [".rs", ".ts", ".py", ".go", ".js", ".md", ".toml", ".yml", ".yaml"]


def _folds() -> tuple[str, str]:
    """Small Latin letters with diacritics and, place by place, their plain letters; then combining marks, which have none."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if chr(cp).islower() and len(parts) > 1 and "a" <= parts[0] <= "z":
            pairs.append((chr(cp), parts[0]))
    return "".join(p[0] for p in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _folds()


def folded(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters; null as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, FOLD_FROM, FOLD_TO)).otherwise(low)


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(text: Column) -> Column:
    """What a tiered query asks for, in order: words of letters, digits and apostrophes, of at least three bytes and no stop words."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))
    return F.filter(F.transform(F.filter(w, lambda x: F.octet_length(x) >= 3), F.lower), lambda x: ~x.isin(STOP_WORDS))


def entity_terms(text: Column) -> Column:
    """Words that may name entities, each once in order, in lower case."""
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.filter(w, lambda x: F.octet_length(x) >= 3), F.lower), lambda x: ~x.isin(ENTITY_STOP_WORDS)))


def rerank_terms(text: Column) -> Column:
    """Distinct words of at least two bytes, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: F.octet_length(x) >= 2))


def is_path(token: Column) -> Column:
    """Whether a word is path-like: it has a slash and a known ending."""
    return F.contains(token, F.lit("/")) & has_file_ending(token)


def has_file_ending(token: Column) -> Column:
    return token.rlike("(" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")


def backticked(text: Column) -> Column:
    """What stands between backticks, pair by pair: not blank, at most 64 characters."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`]*)`"), F.lit(1)), lambda t: (F.trim(t) != "") & (F.length(t) <= 64))


def query_entities(text: Column, most: int = 3) -> Column:
    """Names that a question mentions: backticked ones, then path-like words, the first ``most``."""
    paths = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), is_path)
    return F.slice(F.array_distinct(F.filter(F.concat(backticked(text), paths), lambda n: entity_key(n) != "")), 1, most)


# Phrases of questions that need several steps.
MULTI_HOP = ["how does", "how do", "relate", "related to", "which ", " after ", " before ", "between ", "multi", " vs ", "versus"]


def query_tier(text: Column, temporal: Column) -> Column:
    """easy, normal or hard; ``temporal`` tells whether the question names a time."""
    q = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(q)
    named = F.size(query_entities(q))
    hops = F.lit(False)
    for phrase in MULTI_HOP:
        hops = hops | F.contains(low, F.lit(phrase))
    ticks = (F.length(q) - F.length(F.replace(q, F.lit("`"))) >= 2) | F.contains(low, F.lit("::"))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    hard = temporal | hops | (named >= 2) | ticks
    return F.when(q == "", "easy").when(hard, "hard").when((words <= 3) & (named <= 1), "easy").otherwise("normal")


def normalized(text: Column) -> Column:
    """Lower case, runs of white space as one space, no outer space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def slug(text: Column, most: int = 40) -> Column:
    """Kebab form of at most ``most`` characters; ``untitled`` if nothing is left."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), "-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


# Types that are a topic family of their own.
FAMILIES = ["decision", "policy", "preference", "note", "learning", "config"]


def family(kind: Column) -> Column:
    """Topic family of an observation type."""
    return F.when(kind.isin(FAMILIES), kind).otherwise(F.lit("general"))


def token_estimate(*parts: Column) -> Column:
    """A quarter of the characters of the parts joined by line breaks, rounded up."""
    joined = F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.ceil(F.length(joined) / 4).cast("long")


def dice(a: Column, b: Column) -> Column:
    """Dice overlap of two token arrays as sets; 0 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def entity_key(name: Column) -> Column:
    """Name with nothing but letters, digits and . / _ : in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}./_:]", ""))


def word_chunks(text: Column, most: int = 350, overlap: int = 50) -> Column:
    """Overlapping stretches of ``most`` words; a text that fits stays as it is, trimmed."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    stride = most - overlap
    last = F.ceil(F.greatest(F.size(w) - most, F.lit(0)) / stride).cast("int") * stride
    cut = F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.array_join(F.slice(w, i + 1, most), " "))
    return F.when(F.size(w) <= most, F.array(F.trim(text))).otherwise(cut)


def object_slice(text: Column) -> Column:
    """From the first opening to the last closing brace; empty without both."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def dialogue_ids(text: Column) -> Column:
    """References of the form D12:3."""
    return F.regexp_extract_all(text, F.lit(r"(?i)(d\d*:\d+)"), F.lit(1))


def ordinals(text: Column, most: int) -> Column:
    """Distinct whole numbers 1..most in order of appearance."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(n, lambda x: (x >= 1) & (x <= most)))


def anchor(text: Column) -> Column:
    """Parts of a code anchor: path, path::symbol, path::symbol::line or path:from-to, as a struct (path, symbol, line_start, line_end); null if blank."""
    t = F.trim(text)
    ranged = t.rlike(r"^[^:]*:[0-9]+-[0-9]+$")
    number = lambda i: F.regexp_extract(t, r"^[^:]*:([0-9]+)-([0-9]+)$", i).try_cast("int")
    parts = F.split(t, "::")
    path = F.replace(F.when(ranged, F.regexp_extract(t, "^([^:]*):", 1)).otherwise(F.get(parts, F.lit(0))), F.lit("\\"), F.lit("/"))
    symbol = F.when(~ranged & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1)))
    line = F.get(parts, F.lit(2)).try_cast("int")
    start, end = F.when(ranged, number(1)).otherwise(line), F.when(ranged, number(2)).otherwise(line)
    return F.when(t != "", F.struct(path.alias("path"), symbol.alias("symbol"), start.alias("line_start"), end.alias("line_end")))


def anchor_text(a: Column) -> Column:
    """The one way to write an anchor."""
    path, symbol, lo, hi = a["path"], a["symbol"], a["line_start"], a["line_end"]
    with_symbol = F.when(lo == hi, F.concat_ws("::", path, symbol, lo)).when(lo.isNotNull() & hi.isNotNull(), F.concat(path, F.lit("::"), symbol, F.lit(":"), lo, F.lit("-"), hi)).otherwise(F.concat_ws("::", path, symbol))
    plain = F.when(lo != hi, F.concat(path, F.lit(":"), lo, F.lit("-"), hi)).when(lo.isNotNull(), F.concat_ws("::", path, lo)).otherwise(path)
    return F.when(symbol.isNotNull(), with_symbol).otherwise(plain)


def _lines(text: Column) -> Column:
    """Lines with any ending of lines; a last line break opens no line."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    plain = F.when(plain.endswith("\n"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    return F.split(plain, "\n")


def symbol_lines(text: Column, symbol: Column) -> Column:
    """(from, to): the first line that has the symbol as a whole word, up to the end of its indented block; null without one."""
    lines = _lines(text)
    ident = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), symbol, F.lit(r"\E(?![A-Za-z0-9_])"))
    first = F.array_position(F.transform(lines, lambda x: F.rlike(x, ident)), True)
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^[ \t]+", ""))
    base = indent(F.element_at(lines, F.when(first > 0, first.cast("int")).otherwise(1)))
    after = F.slice(lines, first.cast("int") + 1, F.greatest(F.size(lines) - first.cast("int"), F.lit(0)))
    ends = F.array_position(F.transform(after, lambda x: (F.trim(x) != "") & (indent(x) <= base) & ~F.ltrim(x).rlike(r"^[})]")), True)
    last = F.when(ends > 0, first + ends - 1).otherwise(F.size(lines))
    return F.when((first > 0) & (symbol != ""), F.struct(first.cast("int").alias("from"), last.cast("int").alias("to")))


def locates(text: Column, symbol: Column) -> Column:
    """Whether the symbol stands in the text as a whole word of one line."""
    return (symbol != "") & F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), symbol, F.lit(r"\E(?![A-Za-z0-9_])")))


def slice_digest(text: Column, a: Column) -> Column:
    """SHA-256 of what an anchor points at: its lines, its symbol's block, else the whole text, line ends aside."""
    lines = _lines(text)
    found = symbol_lines(text, a["symbol"])
    lo = F.when(a["line_start"].isNotNull() & a["line_end"].isNotNull(), a["line_start"]).otherwise(found["from"])
    hi = F.when(a["line_start"].isNotNull() & a["line_end"].isNotNull(), a["line_end"]).otherwise(found["to"])
    begin = F.greatest(lo, F.lit(1))
    part = F.array_join(F.slice(lines, begin, F.greatest(F.least(hi, F.size(lines)) - begin + 1, F.lit(0))), "\n")
    whole = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.sha2(F.when(lo.isNull(), whole).otherwise(part), 256)


# Verify states, the worst last.
STATES = ["unanchored", "verified", "stale", "invalidated", "unprovable"]


def state_rank(state: Column) -> Column:
    """Place of a state among ``STATES`` from 0; an unknown one counts as unanchored."""
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in STATES]), state), F.lit(0)) - 1, F.lit(0)).cast("int")


def state_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in STATES]), rank.cast("int") + 1)


def project_name(name: Column) -> Column:
    """Name of a project on disk: lower case, blanks and underscores as hyphens, nothing but letters, digits, dots and hyphens; null if that is empty, hidden or climbs."""
    n = F.regexp_replace(F.translate(F.lower(F.trim(name)), " _", "--"), "[^a-z0-9.-]", "")
    return F.when((n != "") & ~n.startswith(".") & ~F.contains(n, F.lit("..")), n)


def decision_key(question: Column) -> Column:
    return F.concat(F.lit("decision/"), F.substring(F.sha2(F.trim(question), 256), 1, 12))


def preview(text: Column, lines: int = 12, chars: int = 900) -> Column:
    """The first lines in one, cut to a number of characters: for display, not for comparison."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), " "), 1, chars)


def sub_questions(text: Column, most: int = 3) -> Column:
    """Numbered lines of at least eight characters that end in a question mark."""
    q = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.)]\s*", "")))
    return F.slice(F.filter(q, lambda x: (F.length(x) >= 8) & x.endswith("?")), 1, most)


def chain_score(covered: Column, overlap: Column, temporal: Column, sources: Column) -> Column:
    """Strength of a chain of evidence."""
    return covered * 10 + overlap * 3 + F.when(temporal, 4).otherwise(-8) + F.least(sources, F.lit(5))


def evidence_width(question: Column, base: int) -> Column:
    """Width of the evidence window; questions on time get at least 4."""
    return F.when(F.lower(question).rlike("when|before|after|date"), max(base, 4)).otherwise(base)


def fact_line(text: Column) -> Column:
    """Subject, predicate and object of ``subject - predicate - object``; null parts without that form."""
    at = lambda i: F.when(text.rlike(r"^.+? - .+? - .+$"), F.trim(F.regexp_extract(text, r"^(.+?) - (.+?) - (.+)$", i)))
    return F.struct(at(1).alias("subject"), at(2).alias("predicate"), at(3).alias("object"))


def gold_rank(hits: Column, gold: Column) -> Column:
    """Place (from 1) of the first hit that contains ``gold``, case aside; null without one."""
    at = F.array_position(F.transform(hits, lambda h: F.contains(F.lower(h), F.lower(gold))), True)
    return F.when(at > 0, at)


# Words of a question that name a relation in time, and words of a hit that answer it.
RELATIONS = {
    "latest": (["latest", "most recent", "last"], ["latest", "most recent"]),
    "first": (["first", "earliest"], ["first", "earliest"]),
    "before": (["before", "earlier"], ["before", "earlier"]),
    "after": (["after", "later"], ["after", "later"]),
}


def temporal_relation(question: Column) -> Column:
    """latest, first, before, after or any."""
    q, out = F.lower(question), F
    for name, (asks, _) in RELATIONS.items():
        out = out.when(q.rlike("|".join(asks)), name)
    return out.otherwise("any")


def temporal_score(question: Column, hit: Column) -> Column:
    """2 if a hit speaks of the question's relation, -100 if the question names a year that it lacks, else 0."""
    year, low = F.regexp_extract(question, r"(?<!\d)(\d{4})(?!\d)", 1), F.lower(hit)
    relation, out = temporal_relation(question), F.when((year != "") & ~F.contains(low, year), -100)
    for name, (_, answers) in RELATIONS.items():
        out = out.when((relation == name) & low.rlike("|".join(answers)), 2)
    return out.otherwise(0)


def tolerant_array(text: Column, schema: str) -> Column:
    """Objects of a JSON array, also when text stands around it or its end is cut: whole objects are kept."""
    objects = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\{[^{}]*\})"), F.lit(1))
    parsed = F.transform(objects, lambda o: F.from_json(o, schema))
    return F.filter(parsed, lambda o: o.isNotNull())
