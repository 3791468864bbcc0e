"""Paths and texts: Column to Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.constants import CATEGORIES, DOMAINS, LANGUAGES, LAYERS, NOTE_STOPWORDS, SKIP_PATHS, STOPWORDS, TEST_MARKERS


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    up = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(up == "", ".").otherwise(up)


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def _once(parts: dict[str, Column], use) -> Column:
    """An expression over named parts, each of which is evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in parts.items()])), use)[0]


def generalize(path: Column, separators: bool = True) -> Column:
    """``dir/*Tail.ext``: the tail after the last lower-to-upper step, else after - or _ (if asked)."""

    def shape(x: Column) -> Column:
        camel = F.regexp_extract(x["stem"], r"^.*[a-z]([A-Z].*)$", 1)
        out = F.when(camel != "", F.concat(x["up"], F.lit("/*"), camel, x["ext"]))
        for sep in ("-", "_") if separators else ():
            out = out.when(x["stem"].contains(sep), F.concat(x["up"], F.lit(f"/*{sep}"), F.substring_index(x["stem"], sep, -1), x["ext"]))
        return out.otherwise(F.concat(x["up"], F.lit("/*"), x["ext"]))

    return _once({"stem": stem(path), "up": parent(path), "ext": suffix(path)}, shape)


def path_keywords(path: Column) -> Column:
    """Parts of the lower-cased stem longer than one character, then the parent's name."""
    words = F.filter(F.split(F.lower(stem(path)), r"[-_./\\]"), lambda w: F.length(w) > 1)
    up = F.lower(basename(parent(path)))
    more = F.when((F.length(up) > 1) & ~up.isin(".", "src"), F.array(up)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, more))


def domain(path: Column, table: dict[str, list[str]] = DOMAINS) -> Column:
    """The domain with most hits, the first of equals; ``general`` without a hit."""

    def best(x: Column) -> Column:
        hits = [F.struct(reduce(lambda a, b: a + b, [x["low"].contains(w).cast("int") for w in words]).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, (d, words) in enumerate(table.items())]
        none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit("general").alias("d"))
        return F.array_max(F.array(none, *hits))["d"]

    return _once({"low": F.lower(path)}, best)


def tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct lower-cased words of three characters or more that are no stopwords."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[_\-\s]+", " ")), " ")
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))


def query_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """``tokens``, or all words if none is left."""
    found = tokens(text, stopwords)
    return F.when(F.size(found) > 0, found).otherwise(F.array_distinct(F.split(F.trim(F.lower(text)), r"\s+")))


def note_tokens(text: Column, stopwords: list[str] = NOTE_STOPWORDS) -> Column:
    """Words that begin with a letter (Spanish ones too) and hold letters, digits and _."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-záéíóúñü_][a-záéíóúñü0-9_]*"), 0)
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(stopwords))


def index_tokens(name: Column, description: Column) -> Column:
    """Words of a name and the longer words of a description, sorted."""
    own = F.filter(F.split(F.regexp_replace(F.lower(name), "[_-]", " "), r"\s+"), lambda w: w != "")
    said = F.filter(F.split(F.coalesce(description, F.lit("")), r"\s+"), lambda w: F.length(w) > 3)
    return F.array_sort(F.array_union(own, F.transform(said, lambda w: F.btrim(F.lower(w), F.lit(".,;:()[]{}")))))


def category(name: Column, description: Column) -> Column:
    low, said = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    out = None
    for c, (patterns, words) in CATEGORIES.items():
        hit = reduce(lambda a, b: a | b, [low.contains(p) for p in patterns] + [low.contains(w) | said.contains(w) for w in words])
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out.otherwise("other")


def layer(pattern: Column, task: str) -> Column:
    """The first layer of a task type whose expression is found, ignoring case; else null."""
    out = None
    for name, rule in LAYERS[task]:
        hit = pattern.rlike(f"(?i){rule}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def context_name(pattern: Column, task: str) -> Column:
    root = {"bounded_context": "internal/", "feature": "src/features/"}.get(task)
    return F.regexp_replace(pattern, rf"({root})[^/]+(/.+)", r"$1{name}$2") if root else pattern


def commit_type(message: Column) -> Column:
    kinds = [("fix", "bug_fix"), ("feat", "feature_pattern"), ("refactor", "refactor_pattern"), ("perf", "performance_fix")]
    out = None
    for start, kind in kinds:
        hit = F.lower(message).startswith(start)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("general")


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    ext = F.lower(suffix(path))
    return F.coalesce(F.try_element_at(known, ext), F.ltrim(ext, F.lit(".")))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [low.contains(m) for m in TEST_MARKERS])


def is_test_name(path: Column) -> Column:
    """The stricter rule for files that stand for a project's tests: by the file's name alone."""
    name = basename(path)
    return name.contains("_test.go") | name.contains(".test.") | name.contains(".spec.") | name.startswith("test_") | name.endswith("_test.py")


def skipped(path: Column) -> Column:
    """Whether scanners leave a path out: vendored, built or generated."""
    return path.rlike("|".join(SKIP_PATHS))


def mentioned_files(text: Column) -> Column:
    """Distinct file names in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\w/.-]+\.\w+"), 0))


def mentioned_source(text: Column) -> Column:
    """The first path in a text that lies below a source folder; empty without one."""
    return F.regexp_extract(text, r"(?:internal|src|cmd|app|lib|services|components|pkg)/[\w/.-]+\.\w+", 0)


def said_smells(text: Column) -> Column:
    """The number in ``12 smells``; null without one."""
    return F.regexp_extract(text, r"(\d+)\s+smells", 1).try_cast("int")


def status_path(line: Column) -> Column:
    """The path of a short status line (two code letters, a space, a path); of a rename the new one."""
    return F.btrim(F.substring_index(F.substring(line, 4, 1 << 30), " -> ", -1), F.lit("\" "))


def status_code(line: Column) -> Column:
    return F.substring(line, 1, 2)


def context_text(kind: Column, name: Column, description: Column, body: Column) -> Column:
    """``[kind] name``, the description and the body, each on its line if there is one."""
    filled = lambda c: F.when(F.btrim(c, F.lit(" \n\t\r")) != "", F.btrim(c, F.lit(" \n\t\r")))
    return F.concat_ws("\n", F.concat(F.lit("["), kind, F.lit("] "), name), filled(description), filled(body))


def schema_properties(schema: Column) -> Column:
    """Names of a JSON schema's properties, sorted."""
    return F.array_sort(F.coalesce(F.json_object_keys(F.get_json_object(schema, "$.properties")), F.array().cast("array<string>")))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def change_hash(description: Column, schema: Column) -> Column:
    """SHA-1 of a description and a JSON schema, whatever the order of the schema's keys."""
    return F.sha1(F.concat_ws("\n", F.coalesce(description, F.lit("")), F.to_json(F.parse_json(F.coalesce(schema, F.lit("{}"))))))


def tail_path(path: Column, most: int = 60) -> Column:
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit("..."), F.substring(path, -(most - 3), most - 3)))


def duration_seconds(ttl: Column) -> Column:
    """Seconds of ``90d``, ``4w`` or ``48h``; null for anything else."""
    n = F.regexp_extract(ttl, r"^(\d+)([dwh])$", 1)
    unit = F.regexp_extract(ttl, r"^(\d+)([dwh])$", 2)
    each = F.when(unit == "d", 86400).when(unit == "w", 604800).when(unit == "h", 3600)
    return F.when(n != "", n.try_cast("bigint") * each)


def cut_lines(text: Column, most: int = 3000, keep: int = 2970) -> Column:
    """Texts over ``most`` characters end at the last line feed within ``keep``."""
    head = F.substring(text, 1, keep)
    at_line = F.regexp_replace(head, r"\n[^\n]*\z", "")
    return F.when(F.length(text) <= most, text).otherwise(at_line)
