"""Text functions as column expressions: words, identifier parts, n-grams, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters, marks of letters, numbers and ``_``.
WORD = r"([\p{IsAlphabetic}\p{N}_]+)"
#: Case boundaries inside an identifier: lower before upper, or before an upper that a lower follows.
CASE_CUT = r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^_])(?=\p{Lu}\p{Ll})"

#: White space of any script, inside a class of a regular expression.
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"

#: Marks that count as letters where an expression knows no ``Alphabetic``: numbers that are letters, circled letters, vowel signs.
OTHER_LETTERS = r"\p{Nl}\x{24b6}-\x{24e9}\x{0345}\p{Mc}"


def words(text: Column) -> Column:
    """The words of a text in order; null for a null text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def case_parts(word: Column) -> Column:
    """Camel and Pascal pieces of an identifier without ``_``."""
    return F.filter(F.split(word, CASE_CUT), lambda x: x != "")


def snake_parts(word: Column) -> Column:
    """Pieces between underscores."""
    return F.filter(F.split(word, "_"), lambda x: x != "")


def identifier_parts(word: Column) -> Column:
    """Parts of an identifier in lower case, in order of appearance, without repeats.

    Snake pieces count whole only where the word has a ``_``; each snake piece is
    cut by case besides.
    """
    pieces = snake_parts(word)
    whole = F.when(F.contains(word, F.lit("_")), pieces).otherwise(F.array().cast("array<string>"))
    cut = F.flatten(F.transform(pieces, lambda p: F.filter(F.split(p, CASE_CUT), lambda x: x != "")))
    return F.array_distinct(F.transform(F.concat(whole, cut), F.lower))


def embed_tokens(text: Column) -> Column:
    """Words cut by case only, in lower case; identifiers are not kept whole."""
    return F.transform(F.flatten(F.transform(words(text), lambda w: F.filter(F.split(w, r"(?<=\p{Ll})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})"), lambda x: x != ""))), F.lower)


def char_grams(token: Column, n: int = 3) -> Column:
    """The n-grams of a token, prefixed ``c{n}_``; none where it is shorter."""
    return F.when(
        F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.concat(F.lit(f"c{n}_"), F.substring(token, i, F.lit(n))))
    ).otherwise(F.array().cast("array<string>"))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by ``_``."""
    n = F.size(tokens)
    return F.when(n >= 2, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def token_count(text: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def extension(path: Column) -> Column:
    """What follows the last point of a file name, or an empty string."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def trim_dot_slash(path: Column) -> Column:
    """A path without leading ``./``, however often."""
    return F.regexp_replace(path, r"^(\./)+", "")


def slug(title: Column, runs: bool = False) -> Column:
    """Anchor of a heading: lower case; letters, numbers, ``_`` and ``-`` stay, white space becomes one ``-``.

    With ``runs``, as anchors of sections are made, each ``-`` of the title stays,
    and white space adds one unless one stands right before it.
    """
    kept = F.regexp_replace(F.lower(title), rf"[^\p{{IsAlphabetic}}\p{{N}}_\-{SPACE}]", "")
    kept = F.regexp_replace(kept, rf"-?[{SPACE}]+" if runs else rf"[{SPACE}-]+", "-")
    return F.regexp_replace(kept, r"^-+|-+$", "")


def lines(text: Column) -> Column:
    """Lines of a text: a final line end gives no empty line, ``\\r\\n`` counts as one end."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\n\z", ""), "\n")


#: Fence tags by file extension; fixed values.
FENCE_TAGS = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "md": "markdown"}


def fence_tag(path: Column) -> Column:
    """The language tag of a code fence, empty where the extension is unknown."""
    table = F.create_map(*(F.lit(x) for kv in FENCE_TAGS.items() for x in kv))
    return F.coalesce(table[extension(path)], F.lit(""))


def preview(text: Column, n_lines: int = 6) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(lines(text), 1, n_lines), "\n")


def clock(ts: Column) -> Column:
    """Hours, minutes and seconds of a time."""
    return F.date_format(ts, "HH:mm:ss")
