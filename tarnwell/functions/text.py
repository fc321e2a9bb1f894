"""Text functions as Catalyst expressions: identifiers, trigrams, words, paths, sentences."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
#: Case and digit borders, in this order; each puts a blank between its two groups.
BORDERS = ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z0-9])", "([0-9])([A-Za-z])", "([A-Z])([0-9])")
#: What a name with several parts has.
BORDER = "[A-Z][A-Z][a-z]|[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9]|_"


def identifiers(text: Column) -> Column:
    """ASCII identifiers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def identifier_parts(name: Column) -> Column:
    """Lower-cased snake and camel parts of one identifier."""
    for b in BORDERS:
        name = F.regexp_replace(name, b, "$1 $2")
    return F.filter(F.split(F.lower(F.replace(name, F.lit("_"), F.lit(" "))), " +"), lambda x: x != "")


def expand_identifier(name: Column) -> Column:
    """The identifier lower-cased, and after it its parts if there are two or more; one test spares plain words the rest."""
    parts = identifier_parts(name)
    whole = F.array(F.lower(name))
    bordered = name.rlike(BORDER)
    return F.when(~bordered, whole).when(F.size(parts) >= 2, F.concat(whole, parts)).otherwise(whole)


def code_tokens(text: Column) -> Column:
    """All tokens of a text: every identifier and, where it has several, its parts; a null text has none."""
    return F.flatten(F.transform(identifiers(F.coalesce(text, F.lit(""))), expand_identifier))


_NAME, _BORDERS, _BORDER = re.compile(IDENTIFIER.encode()), [re.compile(b.encode()) for b in BORDERS], re.compile(BORDER.encode())


def name_parts(name: bytes) -> list[bytes]:
    """:func:`identifier_parts` of an ASCII name in a Python worker."""
    for b in _BORDERS:
        name = b.sub(rb"\1 \2", name)
    return name.replace(b"_", b" ").lower().split()


def token_counts(text: str) -> dict[bytes, int]:
    """How often a text has each of its :func:`code_tokens`. Letters are folded before names are cut out, as only ASCII ones are; parts
    are made of the names that have a border. A long text is read name by name, so that no list of all its names is made."""
    raw = text.encode()
    names = lambda x: _NAME.findall(x) if len(x) < 1 << 20 else (m.group() for m in _NAME.finditer(x))
    counts = Counter(names(raw.lower()))
    if _BORDER.search(raw):
        for name, c in Counter(n for n in names(raw) if _BORDER.search(n)).items():
            parts = name_parts(name)
            if len(parts) >= 2:
                for p in parts:
                    counts[p] += c
    return counts


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def fold_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, n: int) -> Column:
    """At most ``n`` characters; a longer text ends in an ellipsis within them."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 3)), F.lit("...")))


def cut_to_word(text: Column, n: int) -> Column:
    """At most ``n`` characters, cut back to the last blank before the limit if there is one."""
    head = F.substring(text, 1, n)
    back = F.regexp_replace(head, r" [^ ]*$", "")
    whole = (F.length(text) <= n) | (F.substring(text, n + 1, 1) == " ")
    return F.when(whole, F.rtrim(head)).otherwise(F.rtrim(back))


def normalise(text: Column) -> Column:
    """The key for exact duplicates: lower case, white space folded, no mark at the end."""
    return F.regexp_replace(F.lower(fold_spaces(text)), r"[.!?;:,]+$", "")


def fold_entity(name: Column) -> Column:
    """The key of an entity: lower case, one kind of separator, no blanks, underscores or hyphens."""
    return F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("\\"), F.lit("/")), F.lit("::"), F.lit(".")), "[ _-]", "")


def token_cost(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def file_stem(path: Column) -> Column:
    """The last path component without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def url_path(url: Column) -> Column:
    """The path of a URL, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")


def is_test_path(path: Column) -> Column:
    """A test by its folder or its file name."""
    return path.rlike(r"(^|/)(tests?|specs?|__tests__|testing)/") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test|[^/]*\.(test|spec))\.[A-Za-z0-9]+$") | path.rlike(r"(^|/)conftest\.py$")


def path_penalty(path: Column) -> Column:
    """Factor for a path: tests 0.3, package markers 0.5, compatibility code 0.3, examples 0.3, type declarations 0.7."""
    one = F.lit(1.0)
    out = F.when(is_test_path(path), F.lit(0.3)).otherwise(one)
    for pattern, factor in ((r"(^|/)(__init__\.py|package-info\.java)$", 0.5), (r"(^|/)(_?compat|legacy)/", 0.3), (r"(^|/)(_?examples?|docs?_src)/", 0.3), (r"\.d\.ts$", 0.7)):
        out = out * F.when(path.rlike(pattern), F.lit(factor)).otherwise(one)
    return out


def looks_like_symbol(query: Column) -> Column:
    """A query that is one qualified name ('::', backslash, '->' or '.' between its parts), or one identifier with a capital or an
    underscore in it; blanks around it do not count."""
    q = F.trim(query)
    qualified = q.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+\z")
    return qualified | q.rlike(r"^(?=[a-z0-9]*[A-Z_])[A-Za-z_][A-Za-z0-9_]*\z")


def search_alpha(query: Column) -> Column:
    """Weight of meaning against words: 0.3 for a symbol, else 0.5."""
    return F.when(looks_like_symbol(F.trim(query)), F.lit(0.3)).otherwise(F.lit(0.5))


def causal_cue(text: Column) -> Column:
    """'cause' if the fact names the reason of the one before, 'effect' if it follows from it, else null; 'since <time>' is no cue."""
    t = F.lower(text)
    cause = t.rlike(r"\b(because|due to|owing to)\b") | (t.rlike(r"\bsince\b") & ~t.rlike(r"\bsince (last |yesterday|today|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december|[0-9])"))
    effect = t.rlike(r"\b(therefore|thus|hence|as a result|so that|consequently)\b")
    return F.when(cause, F.lit("cause")).when(effect, F.lit("effect"))


QUOTED = "`([^`\\n]+)`"
QUALIFIED = r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::|/)[A-Za-z_][A-Za-z0-9_]*)*"
BORDERED = r"[a-z0-9][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]|\.|::|/"
PROPER = r"(?<=[a-z,;] )[A-Z][a-z]+(?: [A-Z][a-z]+)*(?!\w|[.:/]\w)"
MOST_ENTITIES = 12


def code_entities(text: Column) -> Column:
    """Names in a text: back-quoted spans, then identifiers with an inner border, then runs of capitalised words; first spelling of each key, at most twelve."""
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    bare = F.regexp_replace(text, QUOTED, " ")
    code = F.filter(F.regexp_extract_all(bare, F.lit(QUALIFIED), F.lit(0)), lambda w: w.rlike(BORDERED))
    proper = F.regexp_extract_all(bare, F.lit(PROPER), F.lit(0))
    names = F.concat(quoted, code, proper)
    keys = F.transform(names, fold_entity)
    first = F.filter(F.transform(names, lambda n, i: F.when(F.array_position(keys, fold_entity(n)) == i + 1, n)), lambda n: n.isNotNull())
    return F.slice(first, 1, MOST_ENTITIES)


def entities_of(text: str) -> list[str]:
    """:func:`code_entities` of one text, for table functions."""
    bare = re.sub(QUOTED, " ", text)
    names = re.findall(QUOTED, text) + [w for w in re.findall(QUALIFIED, bare) if re.search(BORDERED, w)] + re.findall(PROPER, bare, re.A)
    fold = lambda n: re.sub("[ _-]", "", n.lower().replace("\\", "/").replace("::", "."))
    return list({fold(n): n for n in reversed(names)}.values())[::-1][:MOST_ENTITIES]
