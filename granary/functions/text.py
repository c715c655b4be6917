"""Text analysis as Column expressions: tokens, stems, identifiers, coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pattern, dotted names, and words that carry no content in a query.
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
DOTTED = r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9]+)+"
BOUNDARY = r"_+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
STOPWORDS = (
    "a an the and or but if then else when while for to of in on at by with from as is are was were be been being "
    "do does did doing have has had having i you he she it we they me him her us them this that these those there here "
    "what which who whom how why where can could should would will shall may might must not no yes so such than too very "
    "just also into over under again further once any all each few more most other some own same only between both during "
    "before after above below up down out off about against through am its itself my your his their our yourself themselves "
    "ourselves myself get got make made take use used using way thing things something anything nothing everything "
    "someone anyone everyone somewhere anywhere everywhere really actually basically please want need like know think"
).split()
# Fixed value: blank characters of the text model (NBSP and U+FEFF count, unlike in SQL's trim).
BLANK = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
# The same characters one by one, for trimming: linear in the text, which a pattern anchored at its end is not.
BLANK_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text: Column | str) -> Column:
    """Every ASCII word, in order."""
    return F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))


def identifier_parts(token: Column | str) -> Column:
    """The parts of an identifier at underscores, camel humps and acronym ends."""
    return F.filter(F.split(col(token), BOUNDARY), lambda x: x != "")


def stem(token: Column | str) -> Column:
    """The first suffix rule that fits; words of up to four letters stay."""
    t = col(token)
    n = F.length(t)
    short = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(n <= 4, t)
        .when(t.endswith("ies") & (n > 5), F.concat(short(3), F.lit("y")))
        .when(t.endswith("ing") & (n > 6), short(3))
        .when(t.endswith("ed") & (n > 5), short(2))
        .when(t.endswith("es") & ~t.endswith("ses"), short(2))
        .when(t.endswith("s") & ~t.endswith("ss"), short(1))
        .otherwise(t)
    )


def _own_tokens(word: Column) -> Column:
    """A word in lower case, then its parts that differ from it."""
    low = F.lower(word)
    fits = lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$")
    parts = F.transform(identifier_parts(word), lambda p: F.lower(p))
    # a word that is one part only, as most are, has no parts besides itself
    whole = F.filter(F.array(low), fits)
    compound = word.rlike("_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]")
    return F.when(compound, F.concat(whole, F.filter(parts, lambda p: fits(p) & (p != low)))).otherwise(whole)


def tokens(text: Column | str) -> Column:
    """T4: words and their parts with repeats, then the stems that differ."""
    own = F.flatten(F.transform(raw_tokens(text), _own_tokens))
    stems = F.filter(F.transform(own, lambda t: F.when(stem(t) != t, stem(t))), lambda s: s.isNotNull())
    return F.concat(own, stems)


def identifiers(text: Column | str) -> Column:
    """T5: distinct rare identifiers and dotted names, in their own case."""
    t = col(text)
    rare = lambda w: (
        (w.rlike("[_0-9]") | (w.rlike("[a-z]") & w.rlike("[A-Z]")) | (F.length(w) >= 12)) & ~F.lower(w).isin(STOPWORDS)
    )
    dotted = lambda w: (F.length(w) >= 4) & ~w.rlike(r"^[0-9]+(\.[0-9]+)+$")
    names = F.filter(F.regexp_extract_all(t, F.lit(DOTTED), F.lit(0)), dotted)
    return F.array_distinct(F.concat(F.filter(raw_tokens(t), rare), names))


def query_terms(text: Column | str) -> Column:
    """Distinct stems of every token."""
    return F.array_distinct(F.transform(tokens(text), stem))


def content_terms(terms: Column | str) -> Column:
    """Terms without stop words."""
    return F.filter(col(terms), lambda t: ~t.isin(STOPWORDS))


def token_coverage(terms: Column | str, chunk_tokens: Column | str) -> Column:
    """Share of the distinct terms among a chunk's tokens; 0 without terms."""
    n = F.size(col(terms))
    return F.when(n > 0, F.size(F.array_intersect(col(terms), col(chunk_tokens))) / n).otherwise(0.0)


def identifier_hits(ids: Column | str, text: Column | str) -> Column:
    """How many identifiers stand in the text, in their own case."""
    return F.size(F.filter(col(ids), lambda i: F.contains(col(text), i)))


def base_name(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"([^/]*)$", 1))


def file_name_boost(terms: Column | str, base: Column | str, base_tokens: Column | str, boost: float) -> Column:
    """The boost if a term of three letters or more is in the file's name or among the name's tokens."""
    long = F.filter(col(terms), lambda t: F.length(t) >= 3)
    found = F.arrays_overlap(long, col(base_tokens)) | F.exists(long, lambda t: F.contains(col(base), t))
    return F.when(found, F.lit(boost)).otherwise(0.0)


def is_blank(text: Column | str) -> Column:
    """null or only blank characters."""
    return col(text).isNull() | col(text).rlike(f"^[{BLANK}]*$")


def trimmed(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(BLANK_CHARS))


def content_hash(text: Column | str) -> Column:
    """T11."""
    return F.sha1(F.encode(col(text), "UTF-8"))


def truncated(text: Column | str, n: int) -> Column:
    """The first ``n`` characters, with a mark if more follow."""
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("\n…"))).otherwise(t)


def approx_tokens(chars: Column | str) -> Column:
    """A quarter of the characters."""
    return F.round(col(chars) / 4).cast("bigint")


def dot(a: Column | str, b: Column | str) -> Column:
    """A5, in double precision."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    """A5: length of a vector; that of a zero vector is 1."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hash_bucket(token: Column | str, dim: int = 384) -> Column:
    """A token's bucket, from the first four bytes of its md5, low byte first."""
    h = F.md5(F.encode(col(token), "UTF-8"))
    flipped = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    return F.pmod(F.conv(flipped, 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hash_sign(token: Column | str) -> Column:
    """+1 or -1 by the lowest bit of the fifth byte."""
    low = F.substring(F.md5(F.encode(col(token), "UTF-8")), 10, 1)
    return F.when(low.isin(*"13579bdf"), F.lit(1.0)).otherwise(F.lit(-1.0))
