"""Names, paths, questions and answers as Catalyst expressions: what a query asks for, what a path offers, what an answer means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.text import code_tokens, file_stem, fold_spaces

#: Words of a question that say nothing about what is asked for.
COMMON = tuple("about after also and any are been but can could did does for from get had has have how into its may not off one our out over should some such than that the their them then there these they this those through use used using was were what when where which while who why will with would you your".split())
LEAST_WORD, LEAST_RATIO, LEAST_STEM = 3, 0.1, 4


def _common() -> Column:
    return F.array(*[F.lit(w) for w in COMMON])


def symbol_name(query: Column) -> Column:
    """What follows the last separator of a qualified name; of '::', backslash, '->' and '.' the first kind that occurs counts."""
    q = F.trim(query)
    last = lambda sep: F.element_at(F.split(q, sep), -1)
    return F.when(q.contains("::"), last("::")).when(q.contains("\\"), last(r"\\")).when(q.contains("->"), last("->")).when(q.contains("."), last(r"\.")).otherwise(q)


def dotted(query: Column) -> Column:
    """A qualified name with its separators as dots, as names are stored."""
    return F.regexp_replace(F.trim(query), r"::|\\|->", ".")


def symbol_names(query: Column) -> Column:
    """The names a symbol query asks for: its last part, all of it, and all of it with dots; each once."""
    return F.array_distinct(F.array(symbol_name(query), F.trim(query), dotted(query)))


def stem_matches(stem: Column, name: Column) -> Column:
    """Whether a lower-cased file stem is a name, but for underscores and a plural's s."""
    joined = F.replace(stem, F.lit("_"), F.lit(""))
    bare = lambda x: F.regexp_replace(x, "s+$", "")
    return (stem == name) | (joined == name) | (bare(stem) == name) | (bare(joined) == name)


def embedded_symbols(query: Column) -> Column:
    """The words of a question with a capital inside (camelCase, PascalCase), each once, in order."""
    found = F.regexp_extract_all(query, F.lit(r"\b(?:[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)\b"), F.lit(0))
    return F.array_distinct(found)


def embedded_stem_ok(stem: Column, symbols: Column) -> Column:
    """Whether a file stem is one of the lower-cased ``symbols``, or begins one with four characters or more."""
    joined = F.replace(stem, F.lit("_"), F.lit(""))
    begins = lambda s, x: (F.length(x) >= LEAST_STEM) & F.startswith(s, x)
    return F.exists(symbols, lambda s: (s == stem) | (s == joined) | begins(s, stem) | begins(s, joined))


def keywords(query: Column) -> Column:
    """The lower-cased identifier words of three characters or more that are not common, sorted, each once."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    return F.sort_array(F.array_except(F.filter(words, lambda w: F.length(w) >= LEAST_WORD), _common()))


def folder_names(path: Column) -> Column:
    """The folders of a path, the nearest last."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.isin("", ".", ".."))


def path_parts(path: Column) -> Column:
    """The words of a file's stem and of its folder, whole and in parts, sorted, each once."""
    folder = F.coalesce(F.try_element_at(folder_names(path), F.lit(-1)), F.lit(""))
    return F.sort_array(F.array_distinct(F.concat(code_tokens(file_stem(path)), code_tokens(folder))))


def keyword_matches(words: Column, parts: Column) -> Column:
    """How many of ``words`` are among ``parts``, or share a beginning of three characters or more with one of them as a whole."""
    near = lambda w, p: F.when(F.length(w) <= F.length(p), (F.length(w) >= LEAST_WORD) & F.startswith(p, w)).otherwise((F.length(p) >= LEAST_WORD) & F.startswith(w, p))
    return F.size(F.filter(words, lambda w: F.array_contains(parts, w) | F.exists(parts, lambda p: near(w, p))))


def enough_matches(matches: Column, total: Column) -> Column:
    return (total > 0) & (matches / total >= LEAST_RATIO)


# Words that begin a definition.
DEFINING = "class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef"


def module_definitions(text: Column) -> Column:
    """The names (of a qualified one its last part) that stand after a defining word and before a blank, one of ``<({:[;`` or the
    end; each once, in order. A name that is a defining word itself begins a definition too."""
    name = r"[A-Za-z_][A-Za-z0-9_]*+"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?m)(?:^|(?<=\s))(?=(?:{DEFINING})\s+(?:{name}(?:\.|::))*+({name})(?:[\s<(\[{{:;]|\z))"), F.lit(1)))


def sql_definitions(text: Column) -> Column:
    """The lower-cased names that a CREATE statement defines."""
    names = F.regexp_extract_all(text, F.lit(r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|function|procedure|index|type|schema)\s+(?:if\s+not\s+exists\s+)?([A-Za-z_][\w.]*)"), F.lit(1))
    return F.array_distinct(F.transform(names, F.lower))


def indexed_text(kind: Column, start: Column, def_start: Column, doc: Column, text: Column) -> Column:
    """A chunk's text, after its definition's documentation where the chunk begins the definition and does not hold it already."""
    doc = F.regexp_replace(F.coalesce(doc, F.lit("")), r"\.\.\.$", "")
    first = (kind != "module") & start.eqNullSafe(def_start) & (doc != "") & ~F.contains(fold_spaces(text), doc)
    return F.when(first, F.concat(doc, F.lit("\n"), text)).otherwise(text)


def words_text(path: Column, symbol: Column, indexed: Column) -> Column:
    """What a chunk is indexed as: its text, the file stem twice, the last three folders and the qualified name."""
    folders = folder_names(path)
    near = F.array_join(F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), 3), " ")
    return F.concat_ws(" ", indexed, file_stem(path), file_stem(path), near, F.coalesce(symbol, F.lit("")))


def query_terms(question: Column) -> Column:
    """The lower-cased words of over two letters (or with a letter beyond ASCII) that are not common; all words if none is left."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(?U)\w+"), F.lit(0))
    kept = F.array_except(F.filter(words, lambda w: (F.length(w) > 2) | w.rlike(r"[^\x00-\x7F]")), _common())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(words))


def query_tokens(terms: Column) -> Column:
    """The pieces of the terms between underscores, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.filter(F.split(t, "_"), lambda p: p != ""))))


def joined_pieces(name: Column) -> Column:
    """A name without what is neither letter nor digit."""
    return F.regexp_replace(name, r"(?U)[^\w]|_", "")


def call_tail(sig: Column) -> Column:
    """A signature from its first parenthesis outside angle and square brackets (up to two deep); all of it if there is none."""
    inner = r"(?:[^<>\[\]]|<[^<>]*>|\[[^\[\]]*\])*"
    tail = F.regexp_extract(sig, rf"^(?:[^(<\[]|->|<{inner}>|\[{inner}\])*(\(.*)$", 1)
    return F.when(tail != "", tail).otherwise(sig)


def looks_callable(sig: Column) -> Column:
    """Whether a declaration is a function's: a parenthesis, and before it no '=' and no word of another kind of definition."""
    head = F.split(sig, r"\(")[0]
    return sig.contains("(") & ~head.contains("=") & ~head.rlike(r"\b(?:class|struct|enum|trait|interface|impl|type|const|static|let|var|mod|namespace|protocol|object|record|union|typedef|module)\b")


def at_lines(lines: Column, most: int = 6) -> Column:
    """'@12,40', at most ``most`` lines, then ',+K' for the rest; nothing for none."""
    shown = F.array_join(F.transform(F.slice(lines, 1, most), lambda x: x.cast("string")), ",")
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.lit("@"), shown, F.when(F.size(lines) > most, F.concat(F.lit(",+"), (F.size(lines) - most).cast("string"))).otherwise("")))


def looks_like_code(word: Column) -> Column:
    """An underscore, a dot, '::', or a capital after the first character."""
    return word.contains("_") | word.contains(".") | word.contains("::") | F.substring(word, 2, 10_000).rlike("[A-Z]")


def code_names(text: Column, most: int = 64) -> Column:
    """Names in a task: what stands in backticks up to a parenthesis, words that look like code, words before '('; each once."""
    pieces = F.regexp_extract_all(text, F.lit(r"`[^`]+`|[\w.:/]+\(?"), F.lit(0))
    named = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("`")), F.split(F.regexp_replace(p, "`", ""), r"\(")[0]).when(F.endswith(p, F.lit("(")), F.regexp_replace(p, r"\($", "")).when(looks_like_code(F.regexp_replace(p, r"^\W+|\W+$", "")), p))
    clean = F.transform(F.filter(named, lambda p: p.isNotNull()), lambda p: F.regexp_replace(p, r"^[^\w]+|[^\w]+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda p: p != "")), 1, most)


def whole_words(line: Column) -> Column:
    """A line cut to size ('...') goes back to the end of the word before, if the cut left part of a word and there is one before."""
    head = F.regexp_replace(line, r"\.\.\.$", "")
    back = F.regexp_replace(head, r"\s+\S*$", "")
    halved = F.endswith(line, F.lit("...")) & head.rlike(r"[A-Za-z0-9_]$") & head.rlike(r"\S\s")
    return F.when(halved, F.concat(F.rtrim(back), F.lit("..."))).otherwise(line)


# -- answers and challenges -----------------------------------------------------------------------------------------


def bare(name: Column) -> Column:
    """The last part of a name, whatever path, call or line came with it."""
    first = F.regexp_extract(F.split(F.replace(name, F.lit("`"), F.lit(" ")), r"\(")[0], r"^\s*(\S*)", 1)
    return F.element_at(F.split(first, r"::|:|\."), -1)


def plain(value: Column) -> Column:
    """Lower-cased, without blanks and marks at either end."""
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"""^[\s`'"*_()\[\]{}<>.,;:!?]+|[\s`'"*_()\[\]{}<>.,;:!?]+$""", ""))


def same_file(given: Column, truth: Column) -> Column:
    """The right file name, whatever folder, backticks or ':line' came with it."""
    name = F.element_at(F.split(F.regexp_replace(F.replace(F.trim(F.replace(F.coalesce(given, F.lit("")), F.lit("`"), F.lit(""))), F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)
    return F.regexp_replace(name, r":\d+(-\d+)?$", "") == truth


def plain_roles(given: Column) -> Column:
    """Sorted plain names of a list whose items may hold several, joined by '+' or a comma."""
    return F.sort_array(F.filter(F.transform(F.flatten(F.transform(given, lambda x: F.split(x, "[+,]"))), plain), lambda x: x != ""))


def clean_subject(subject: Column) -> Column:
    """A commit subject without its scope prefix, links, ticket numbers and closing marks."""
    t = F.regexp_replace(F.trim(subject), r"^(?:\[[^\]]{1,30}\]\s*)*(?:[A-Za-z][\w-]{0,29}(?:\([^)]*\))?!?:\s+)?", "")
    t = F.regexp_replace(t, r"https?://\S+", "")
    t = F.regexp_replace(t, r"(?i)\((?:[a-z]+\s*)?#\d+\)|(?<!\w)#\d+\b|\bgh-\d+\b", "")
    return F.regexp_replace(fold_spaces(t), r"[\s.,;:!?-]+$", "")


def contains_run(haystack: Column, needle: Column) -> Column:
    """Whether the array ``needle`` stands in ``haystack`` as a run; an empty one never does."""
    joined = lambda a: F.concat(F.lit("\x1f"), F.array_join(a, "\x1f"), F.lit("\x1f"))
    return (F.size(needle) > 0) & F.contains(joined(haystack), joined(needle))


def name_in_query(query: Column, name: Column) -> Column:
    """Whether a query gives the answer away: it holds the name as a word, or the run of the name's tokens."""
    words = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.array_contains(words, F.lower(name)) | contains_run(code_tokens(query), code_tokens(name))


def is_strict_test_path(path: Column) -> Column:
    """A test by any folder's name, or a file whose stem begins or ends as tests' do."""
    p = F.lower(path)
    return p.rlike(r"(^|/)(test|tests|testing|__tests__|spec|specs)/") | p.rlike(r"(^|/)(test_[^/]*|[^/]*_tests?|tests?|conftest|[^/]*\.(test|spec))(\.[^./]*)?$")


def age_word(seconds: Column) -> Column:
    """'40s', '12m', '5h' or '3d'; a time to come is now."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    text = lambda unit, mark: F.concat(F.floor(s / unit).cast("string"), F.lit(mark))
    return F.when(s < 90, text(1, "s")).when(s < 5_400, text(60, "m")).when(s < 172_800, text(3_600, "h")).otherwise(text(86_400, "d"))


def parse_date(text: Column, end_of_day: bool = False) -> Column:
    """Unix seconds of '2026-10-12', '2026-10-12 14:30' or '2026-10-12T14:30:05', a Z after it allowed; null for anything else."""
    t = F.regexp_replace(F.trim(text), "[Zz]$", "")
    part = lambda i: F.regexp_extract(t, r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ]\s*(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*)?$", i)
    day = F.try_to_date(F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))), "yyyy-MM-dd")
    number = lambda i: F.when(part(i) == "", 0).otherwise(part(i).cast("int"))
    clock = F.when(part(4) == "", 86_399 if end_of_day else 0).when((number(4) < 24) & (number(5) < 60) & (number(6) < 60), number(4) * 3_600 + number(5) * 60 + number(6))
    return (F.unix_date(day).cast("long") * 86_400) + clock


def anonymised(text: Column) -> Column:
    """User names in paths replaced."""
    return F.regexp_replace(text, r"(?i)((?:/home/|/users/|[a-z]:\\users\\))[^/\\\s\"']+", "$1user")


def valid_name(name: Column) -> Column:
    """Names of banks, tasks and roles: a letter or digit, then up to 63 letters, digits, dots, hyphens and underscores."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$") & ~name.contains("..")

