"""Column expressions over paths, names, links and texts.  All stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, and extensions that never hold source.
LANGUAGES = {
    "markdown": (".md", ".markdown"),
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx", ".mjs"),
    "go": (".go",),
    "python": (".py",),
    "rust": (".rs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".hpp"),
}
# Directories and file names that are never indexed.
IGNORED_DIRS = (".git", "node_modules", ".tagloom", "vendor", "dist", "build", "out", ".angular", ".next", ".nuxt", ".svelte-kit", "__pycache__", ".pytest_cache", ".mypy_cache", "coverage", ".nyc_output", ".turbo", ".cache", ".obsidian", ".trash")
IGNORED_SUFFIXES = (".d.ts", ".min.js", ".pb.go", ".gen.go", ".canvas", ".excalidraw", ".db", ".db-wal", ".db-shm")
# Names of test files.
TEST_SUFFIXES = ("_test.py", "_test.go", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "pdf")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the last segment, '' without one."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def lang_of(path: Column) -> Column:
    base, ext = F.lower(base_name(path)), F.lower(extension(path))
    out = F.when(base.endswith(".pb.go") | (base == ".env") | base.startswith(".env."), "")
    for lang, exts in LANGUAGES.items():
        out = out.when(ext.isin(*exts), lang)
    return out.otherwise("")


def maybe_source(path: Column) -> Column:
    base = base_name(path)
    return (lang_of(path) != "") | ((extension(base) == "") & ~base.startswith("."))


def shebang_lang(head: Column) -> Column:
    """Language named by a '#!' first line ('' if none): the interpreter, or what ``env`` runs, without its version."""
    line = F.regexp_extract(head, r"\A#!([^\n]*)", 1)
    fields = F.filter(F.split(line, r"\s+"), lambda f: f != "")
    first = base_name(F.get(fields, F.lit(0)))
    run = F.get(F.filter(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))), lambda f: ~f.startswith("-") & ~f.contains("=")), F.lit(0))
    name = F.regexp_replace(F.when(first == "env", base_name(run)).otherwise(first), r"[0-9.]+\z", "")
    return F.when(name.isin("python", "pypy"), "python").when(name.isin("node", "nodejs", "bun"), "javascript").when(name.isin("deno", "ts-node", "tsx"), "typescript").otherwise("")


def detect_lang(path: Column, head: Column) -> Column:
    own = lang_of(path)
    return F.when(own != "", own).when(maybe_source(path), shebang_lang(F.substring(head, 1, 256))).otherwise("")


def is_test(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    base, segments = base_name(p), F.split(p, "/")
    named = (base.startswith("test_") & base.endswith(".py")) | (base == "conftest.py")
    for s in TEST_SUFFIXES:
        named = named | base.endswith(s)
    inside = F.arrays_overlap(segments, F.array(*[F.lit(x) for x in ("tests", "__tests__", "testdata")]))
    parent = (F.size(segments) >= 2) & (F.get(segments, F.size(segments) - 2) == "test")
    return named | inside | F.coalesce(parent, F.lit(False))


def category(path: Column) -> Column:
    return F.when(lang_of(F.replace(path, F.lit("\\"), F.lit("/"))) == "markdown", "docs").when(is_test(path), "test").otherwise("source")


def unexported(name: Column, lang: Column) -> Column:
    return (
        F.when(name == "", False)
        .when(lang == "go", name.rlike(r"\A[a-z]"))
        .when(lang == "python", name.startswith("_") & ~name.startswith("__"))
        .when(lang.isin("typescript", "javascript"), name.startswith("_"))
        .otherwise(False)
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")


def symbol_key(rel_file: Column, name: Column, kind: Column, lang: Column) -> Column:
    return F.when((lang == "markdown") & (kind != "ref"), F.concat(rel_file, F.lit("#"), slug(name))).otherwise(name)


def kind_of(capture: Column) -> Column:
    from tagloom.schema import DEFINITION_KINDS

    tail = F.regexp_extract(capture, r"\Aname\.definition\.(.*)\z", 1)
    return F.when(capture.startswith("name.reference"), "ref").when(tail.isin(*DEFINITION_KINDS), tail).otherwise("def")


# ------------------------------------------------------------------ links


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def strip_fragment(dest: Column) -> Column:
    return strip(F.substring_index(F.substring_index(dest, "#", 1), "?", 1))


def is_external(dest: Column) -> Column:
    return dest.startswith("//") | F.lower(dest).rlike(r"\A(https?://|ftp://|mailto:|tel:)") | dest.rlike(r"\A[A-Za-z0-9+.-]{2,}:")


def is_image(dest: Column) -> Column:
    return F.lower(extension(dest)).isin(*["." + e for e in IMAGE_EXTENSIONS])


def looks_like_path(dest: Column) -> Column:
    return dest.rlike(r"[/\\]") | dest.startswith(".") | (extension(strip_fragment(dest)) != "")


def bare_name(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?i)\.(md|markdown)\z", "")


def clean_path(path: Column) -> Column:
    """Segments folded over a stack; null where the path climbs above its root, '' where it is the root."""
    none = F.lit(None).cast("array<string>")

    def push(stack, seg):
        return (
            F.when(stack.isNull() | seg.isin("", "."), stack)
            .when((seg == "..") & (F.size(stack) == 0), none)
            .when(seg == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(seg)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), push), "/")


def resolve_relative(dest: Column, source: Column) -> Column:
    folder = F.regexp_extract(source, r"\A(.*)/[^/]*\z", 1)
    return F.nullif(clean_path(F.concat(folder, F.lit("/"), dest)), F.lit(""))


def link_target(dest: Column):
    """(target text, is a wikilink) of a link as written; target is null where the link makes no edge."""
    d = strip(dest)
    inner = F.when(d.startswith("[[") & d.endswith("]]"), F.regexp_replace(d, r"\A\[\[|\]\]\z", "")).otherwise(d)
    wiki = ~looks_like_path(inner) & ~is_external(inner)
    target = strip_fragment(F.when(inner.contains("|"), strip(F.substring_index(inner, "|", 1))).otherwise(inner))
    return F.when((target == "") | is_external(target) | is_image(target), F.lit(None)).otherwise(target), wiki


# ------------------------------------------------------------------ budgets and lines


def estimate_tokens(text: Column) -> Column:
    digits = F.regexp_count(text, F.lit("[0-9]"))
    return (digits + F.floor(((F.octet_length(text) - digits) * 10 + 31) / 32)).cast("int")


def quarter_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("int")


def budget(asked: Column, default: int, most: int = 8000) -> Column:
    return F.when(asked <= 0, default).otherwise(F.least(asked, F.lit(most)))


def clip(text: Column, most: int = 160) -> Column:
    """A line as answers show it: trimmed, tabs as spaces, cut at ``most`` bytes; a character that the cut breaks is one U+FFFD."""
    t = F.replace(strip(text), F.lit("\t"), F.lit(" "))
    cut = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def word_pattern(name: str) -> str:
    return "(^|[^A-Za-z0-9_])" + re.sub(r"([^A-Za-z0-9_])", r"\\\1", name) + r"(\z|[^A-Za-z0-9_])"


def has_word(text: Column, name: str) -> Column:
    """A cheap substring test first, the pattern only for what passes."""
    return text.contains(name) & text.rlike(word_pattern(name))


def span(line: Column, end_line: Column) -> Column:
    return F.when(end_line > line, F.concat(line.cast("string"), F.lit("-"), end_line.cast("string"))).otherwise(line.cast("string"))


def norm_path(path: str) -> str:
    """A path argument: trimmed, './' and redundant segments gone, '' for the root."""
    p = path.strip()
    p = p[2:] if p.startswith("./") else p
    out: list[str] = []
    for seg in p.split("/"):
        if seg == "..":
            out = out[:-1]
        elif seg not in ("", "."):
            out.append(seg)
    return "/".join(out)


def under(rel: Column, path: str) -> Column:
    p = norm_path(path)
    return F.lit(True) if not p else (rel == p) | rel.startswith(p + "/")


# ------------------------------------------------------------------ ignoring


def ignored_by_default(path: Column) -> Column:
    base = base_name(path)
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in IGNORED_DIRS]))
    for s in IGNORED_SUFFIXES:
        out = out | base.endswith(s)
    return out
