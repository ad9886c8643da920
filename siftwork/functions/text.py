"""Lines, tokens, sentences, n-grams and placeholders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of sentences: after . ! ? unless inside a number, a single-letter abbreviation or an ellipsis, before a lower-case
#: letter or a closing bracket; blanks must be followed by an upper-case letter or the end.
SENTENCE_END = (
    r"(?U)(?<=[.!?])(?<![0-9][.!?])(?<!(?:\A|\P{IsAlphabetic})\p{IsAlphabetic}[.!?])(?<!\.\.)(?!(?<=\.)\.)"
    r"(?!\))(?!\p{IsLowercase})(?:(?=[ \n\t]\s*(?:\p{IsUppercase}|\z))|(?![ \n\t]))"
)


#: White space of any script, as in the Unicode property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lines(text: Column) -> Column:
    """Lines, split at LF with one CR before it taken off; a final LF opens no line."""
    a = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(a)


def tokens(line: Column) -> Column:
    """Words between white space of any script."""
    return F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences of a text, trimmed."""
    kept = F.filter(F.transform(lines(text), lambda s: F.btrim(s, F.lit(WHITE))), lambda x: x.rlike(r"[\p{IsAlphabetic}\p{N}]"))
    parts = F.split(F.array_join(kept, " "), SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")), lambda s: s != "")


def is_full_sentence(s: Column) -> Column:
    """At least two words with a letter or digit, and eight bytes or three words."""
    n = F.size(tokens(s))
    return (n >= 2) & s.rlike(r"[\p{IsAlphabetic}\p{N}]") & ((F.octet_length(s) >= 8) | (n >= 3))


def normal_token(t: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]", ""))


def ngrams(tok: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, joined by a blank."""
    n = F.size(tok)

    def runs(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tok, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[runs(k) for k in range(low, high + 1)]))


def placeholder(kind: str, i: Column) -> Column:
    """[KIND_00]; numbers of more than two digits aren't cut. PREFIX and SUFFIX have none."""
    if kind in ("PREFIX", "SUFFIX"):
        return F.lit(f"[{kind}]")
    return F.format_string(f"[{kind}_%02d]", i.cast("int"))


def is_end_mark(c: Column) -> Column:
    """Whether a character ends sentences."""
    return c.isin(".", "!", "?")


def is_quote(c: Column) -> Column:
    return c.isin('"', "'")


def end_type(s: Column) -> Column:
    t = F.rtrim(s)
    return F.when(t.endswith("?"), "question").when(t.endswith("!"), "exclamation").otherwise("period")


def line_ending(text: Column) -> Column:
    """lf, crlf, cr, mixed, or null where there is no line break."""
    crlf, lf, cr = F.regexp_count(text, F.lit(r"\r\n")), F.regexp_count(text, F.lit(r"(?<!\r)\n")), F.regexp_count(text, F.lit(r"\r(?!\n)"))
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").when(cr > 0, "cr")


def greedy_pattern(tok: Column, frequent: Column, low: int = 2, high: int = 4) -> Column:
    """The tokens with every token outside a frequent n-gram replaced by [WORD_i], longest n-grams first, from the left.

    A fold over positions; i is the token's position.
    """
    start = F.struct(F.lit(0).alias("nx"), F.array().cast("array<string>").alias("o"))

    def step(acc, i):
        out = F.struct((i + 1).alias("nx"), F.concat(acc["o"], F.array(placeholder("WORD", i))).alias("o"))
        for k in range(low, high + 1):
            gram = F.array_join(F.slice(tok, i + 1, k), " ")
            hit = (i + k <= F.size(tok)) & F.array_contains(frequent, gram)
            out = F.when(hit, F.struct((i + k).alias("nx"), F.concat(acc["o"], F.array(gram)).alias("o"))).otherwise(out)
        return F.when(i < acc["nx"], acc).otherwise(out)

    folded = F.aggregate(F.sequence(F.lit(0), F.size(tok) - 1), start, step)
    return F.when(F.size(tok) > 0, F.array_join(folded["o"], " ")).otherwise("")
