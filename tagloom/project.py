"""A project: its relations, its answers as text, and its refresh after changes."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.operators import blast, cache, callers, changes, deadcode, graph, outline, search
from tagloom.scratch import stored
from tagloom.sources import tree
from tagloom.sources.store import TagCache


def estimate(text: str) -> int:
    raw = text.encode()
    digits = sum(48 <= b <= 57 for b in raw)
    return digits + ((len(raw) - digits) * 10 + 31) // 32


class Budget:
    """Collects text up to a token budget."""

    def __init__(self, asked: int, default: int) -> None:
        self.most = default if asked <= 0 else min(asked, 8000)
        self.used, self.parts = 0, []

    def fits(self, text: str, reserve: int) -> bool:
        return self.used + estimate(text) + reserve <= self.most

    def add(self, text: str) -> None:
        self.used += estimate(text)
        self.parts.append(text)

    def take(self, entries: list[str], reserve: int) -> int:
        """Adds entries until one does not fit; how many were left out."""
        for i, e in enumerate(entries):
            if not self.fits(e, reserve):
                return len(entries) - i
            self.add(e)
        return 0

    def text(self) -> str:
        return "".join(self.parts)


@dataclass
class Project:
    spark: SparkSession
    files: DataFrame
    tags: DataFrame
    lines: DataFrame
    links: graph.Links
    ranks: DataFrame
    root: str = ""
    cache: TagCache | None = None

    @classmethod
    def of_tags(cls, tags: DataFrame, files: DataFrame, lines: DataFrame, root: str = "", kept: TagCache | None = None) -> Project:
        tags = stored(tags)
        links = graph.links(tags, tables=True)
        ranks = graph.pagerank(tags.select("rel_file"), links)
        return cls(tags.sparkSession, stored(files), tags, stored(lines), links, ranks, root, kept)

    @property
    def edges(self) -> DataFrame:
        """All edges as pairs: no answer needs them, and they grow with the square of a name's files."""
        return graph.edges(self.tags)

    @classmethod
    def open(cls, spark: SparkSession, root: str, cache_folder: str = "") -> Project:
        """The tree below ``root``; with ``cache_folder`` only files whose time differs from the cached one are parsed."""
        files = stored(tree.tree_files(spark, root))
        everything = tree.tree_contents(files, root)
        lines = tree.lines_of(everything.union(_texts(files, root)))
        if not cache_folder:
            return cls.of_tags(tree.parse(everything), files, lines, root)
        kept = TagCache(spark, f"{cache_folder.rstrip('/')}/{cache.fingerprint(os.path.realpath(root))[:16]}")
        cached, tags = kept.load()
        known = stored(cache.split_hits(files, cached))
        changed = known.where("NOT hit").select("rel_file")
        if changed.isEmpty() and cached.count() == known.count():
            return cls.of_tags(tags, files, lines, root, kept)
        still = tags.join(known.where("hit").select("rel_file"), "rel_file", "left_semi")
        fresh = tree.parse(tree.tree_contents(files.join(changed, "rel_file", "left_semi"), root))
        out = cls.of_tags(cache.refreshed(still, changed, fresh), files, lines, root, kept)
        kept.save(out.files, out.tags)
        return out

    def refresh(self, changed: list[str]) -> Project:
        """The project after ``changed`` files: theirs are parsed anew or dropped; graph and ranks are rebuilt."""
        names = self.spark.createDataFrame([(c,) for c in changed if tree.inside(c)], "rel_file string")
        now = tree.tree_files(self.spark, self.root).join(names, "rel_file", "left_semi")
        content = tree.tree_contents(now, self.root)
        files = self.files.join(names, "rel_file", "left_anti").unionByName(now)
        lines = self.lines.join(names, "rel_file", "left_anti").unionByName(tree.lines_of(content.union(_texts(now, self.root))))
        out = Project.of_tags(cache.refreshed(self.tags, names, tree.parse(content)), files, lines, self.root, self.cache)
        if self.cache:
            self.cache.save(out.files, out.tags)
        return out

    # ------------------------------------------------------------ answers

    def repo_map(self, map_tokens: int = 8192, chat_files=None, force_refresh: bool = False) -> str:
        """``chat_files`` is accepted and has no effect; ``force_refresh`` rebuilds graph and ranks."""
        del chat_files
        now = Project.of_tags(self.tags, self.files, self.lines, self.root, self.cache) if force_refresh else self
        rows = search.repo_map(search.map_sections(now.tags, now.ranks), map_tokens).orderBy("place").collect()
        return "".join(r["section"] for r in rows)

    def search_identifiers(self, query: str, filter: str = "both", limit: int = 50, kinds=None) -> str:  # noqa: A002
        rows = search.search_identifiers(self.tags, query, filter, limit, kinds).collect()
        return json.dumps([{"rel_file": r["rel_file"], "line": r["line"], **({"end_line": r["end_line"]} if r["end_line"] else {}), "name": r["name"], "kind": r["kind"], **({"lang": r["lang"]} if r["lang"] else {})} for r in rows] or None)

    def search(self, query: str, refs: bool = False, include_tests: bool = False, path: str = "", max_tokens: int = 0) -> str:
        if not query.strip():
            return "query is empty\n"
        w = Budget(max_tokens, 600)
        n = search.matched(self.tags, query, refs, True, path).agg(F.count(F.lit(1)).alias("all"), F.count_if(C.is_test(F.col("rel_file"))).alias("test")).first()
        hidden = 0 if include_tests else n["test"]
        total = n["all"] - hidden
        # no entry costs less than a token, so no more than the budget can be shown
        shown = search.search(self.tags, self.ranks, query, refs, include_tests, path, w.most)
        entries = [r["entry"] for r in search.search_entries(shown).orderBy("place").collect()]
        w.add(f"{json.dumps(query, ensure_ascii=False)}: {total} {'definitions and references' if refs else 'definitions'}" + (f", {hidden} more in tests (include_tests=true)" if hidden else "") + "\n")
        if left := total - len(entries) + w.take(entries, 40):
            w.add(f"[truncated at max_tokens={w.most}: {left} more; use a longer query or path=]\n")
        return w.text()

    def blast_radius(self, symbol: str, max_depth: int = 3, file: str = "") -> str:
        return blast.blast_radius(self.tags, self.links, symbol, min(max_depth, 10), file).select(F.to_json(F.struct("*")).alias("j")).first()["j"]

    def find_dead_code(self, kinds=None, min_rank: float = 0.0, include_test_symbols=False, include_test_orphans=False, include_doc_orphans=False, unexported_only=False, exported_only=False) -> dict:
        if unexported_only and exported_only:
            raise ValueError("unexported_only and exported_only exclude each other")
        dead = deadcode.dead_candidates(self.tags, kinds, unexported_only, exported_only)
        nodes = self.tags.select("rel_file").distinct()
        orphan = deadcode.orphan_candidates(nodes, self.links, self.ranks, min_rank or deadcode.DEFAULT_MIN_RANK)
        shown = dead if include_test_symbols else dead.where("category <> 'test'")
        hidden = [c for c, keep in (("test", include_test_orphans), ("docs", include_doc_orphans)) if not keep]
        alone = orphan.where(~F.col("category").isin(*hidden)) if hidden else orphan
        d = [r.asDict() for r in shown.orderBy("rel_file", "line").collect()]
        o = [r.asDict() for r in alone.orderBy("rel_file").collect()]
        hd, ho = dead.count() - len(d), orphan.count() - len(o)
        clauses = ([f"{hd}{deadcode.HIDDEN_SYMBOLS}"] if hd else []) + ([f"{ho}{deadcode.HIDDEN_ORPHANS}"] if ho else [])
        return {"dead_symbols": d, "orphan_files": o, "summary": f"{len(d)} dead symbols, {len(o)} orphan files" + (f" ({'; '.join(clauses)})" if clauses else "")}

    def changed_symbols(self, diff: str = "", git_ref: str = "", include_blast_radius: bool = False) -> dict:
        if not diff and not git_ref:
            raise ValueError("diff or git_ref is required")
        try:
            text = diff or changes.git_diff(self.root, git_ref)
        except (ValueError, subprocess.CalledProcessError, OSError) as e:
            return {"changed_symbols": [], "summary": f"git diff failed: {e}"}
        hunks = stored(changes.parse_diff(self.spark.createDataFrame([(text,)], "diff string")))
        found = stored(changes.changed_symbols(self.tags, hunks))
        rows = [r.asDict() for r in found.orderBy("file", "line").collect()]
        if include_blast_radius:
            size = {(r["symbol"], r["file"]): r["total_files_affected"] for r in changes.changed_blast(self.tags, self.links, found).collect()}
            rows = [r | {"blast_radius": size.get((r["symbol"], r["file"]), 0)} for r in rows]
        return {"changed_symbols": rows, "summary": changes.summary(found, hunks).first()["summary"]}

    def outline(self, path: str = "", all_kinds: bool = False, include_tests: bool = False, max_tokens: int = 0) -> str:
        p = C.norm_path(path)
        w = Budget(max_tokens, 1500)
        own = self.tags.where(F.col("rel_file") == p)
        count = lambda f: self.lines.where(F.col("rel_file") == f).count()
        if p and own.limit(1).count():
            rows = outline.file_outline(own, all_kinds).orderBy("line", F.col("end_line").desc()).select("*", C.span(F.col("line"), F.col("end_line")).alias("span")).collect()
            w.add(f"{p} ({count(p)} lines, {len(rows)} definitions)\n")
            if left := w.take([f"{'  ' * (r['depth'] + 1)}{r['span']} {r['kind']} {r['name']}\n" for r in rows], 40):
                w.add(f"[truncated at max_tokens={w.most}: {left} more definitions from line {rows[-left]['line']}; raise max_tokens]\n")
            return w.text()
        if p and self.files.where(F.col("rel_file") == p).limit(1).count():
            return f"{p}: {count(p)} lines, not parsed; grep or read a range instead\n"
        under = C.under(F.col("rel_file"), p)
        source = self.tags.where(under & (C.lang_of(F.col("rel_file")) != "markdown"))
        shown = source if include_tests else source.where(~C.is_test(F.col("rel_file")))
        n, total = (x.select("rel_file").distinct().count() for x in (shown, source))
        unparsed = self.files.where(under).join(self.tags.select("rel_file").distinct(), "rel_file", "left_anti").count()
        shown_dir = p + "/" if p else "."
        if not n:
            return f"{shown_dir}: no parsed source files ({unparsed} other files)\n"
        w.add(f"{shown_dir}: {n} source files" + (f", {total - n} test files hidden (include_tests=true)" if total > n else "") + (f", {unparsed} files not parsed" if unparsed else "") + ". Top-level definitions with start lines; outline a file for nested ranges.\n")
        counts = self.lines.groupBy("rel_file").agg(F.count(F.lit(1)).alias("n_lines"))
        entries = outline.directory_entries(shown, counts, all_kinds)
        picked = outline.chosen(entries, self.ranks, w.used, w.most).collect()
        for r in sorted(picked, key=lambda r: r["rel_file"]):
            w.add(r["entry"])
        if missing := n - len(picked):
            names = {r["rel_file"] for r in picked}
            rest = [r["rel_file"] for r in shown.select("rel_file").distinct().join(self.ranks, "rel_file", "left").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "rel_file").limit(len(picked) + w.most).collect() if r["rel_file"] not in names]
            note, listed = f"[truncated at max_tokens={w.most}: {missing} lower-ranked files not shown", ""
            for f in rest:
                if not w.fits(f"{note}{listed}, {f}, …; outline a subdirectory]\n", 0):
                    listed += ", …"
                    break
                listed += f", {f}" if listed else f": {f}"
            w.add(f"{note}{listed}; outline a subdirectory]\n")
        return w.text()

    def callers(self, symbol: str, file: str = "", depth: int = 1, context: int = 0, include_tests: bool = False, path: str = "", max_tokens: int = 0) -> str:
        depth = min(max(depth, 1), 3)
        w = Budget(max_tokens, 2000 if depth > 1 else 1500)
        texts = {}
        want = lambda rows: texts.update({(r["rel_file"], r["line"]): r["text"] for r in self.lines.join(self.spark.createDataFrame(sorted(rows), "rel_file string, line int"), ["rel_file", "line"]).select("rel_file", "line", C.clip(F.col("text")).alias("text")).collect()}) if rows else None
        origin = C.norm_path(file)
        defs = self.tags.where((F.col("kind") != "ref") & (F.col("lang") != "markdown") & (F.col("name") == symbol)).select("*", C.span(F.col("line"), F.col("end_line")).alias("span")).orderBy("rel_file", "ord").collect()
        defs = [d for d in defs if not origin or d["rel_file"] == origin]
        rows = callers.callers(self.tags, self.lines, symbol, file, depth, path, include_tests)
        rows = rows.select("*", C.span(F.col("fn_line"), F.col("fn_end")).alias("span")).orderBy("depth", "name", "rel_file", "line").collect()
        first = [r for r in rows if r["depth"] == 1]
        sites = [r for r in first if r["status"] == "shown"]
        plain = callers.text_sites(self.tags, self.files, self.lines, symbol, path, include_tests).orderBy("rel_file", "line").collect()
        other = callers.mentions(self.tags, self.lines, symbol, path, include_tests).orderBy("rel_file", "line").collect()
        grep, said = [t for t in plain if not t["hidden"]], [m for m in other if not m["hidden"]]
        near = {(r["rel_file"], n) for r in sites for n in range(r["line"] - min(max(context, 0), 3), r["line"] + min(max(context, 0), 3) + 1)}
        want(near | {(r["rel_file"], r["line"]) for r in rows} | {(m["rel_file"], m["line"]) for m in said} | {(d["rel_file"], d["line"]) for d in defs[:1]})
        line = lambda f, n: texts.get((f, n), "")
        if not defs:
            w.add(f"{symbol}: no definition found in parsed files\n")
        elif len(defs) == 1:
            d = defs[0]
            w.add(f"{symbol}: defined {d['rel_file']}:{d['span']} {d['kind']}\n")
            if line(d["rel_file"], d["line"]):
                w.add(f"  {line(d['rel_file'], d['line'])}\n")
        else:
            w.add(f"{symbol}: {len(defs)} definitions (references below match by name, not by type):\n")
            for d in defs[:5]:
                w.add(f"  {d['rel_file']}:{d['span']} {d['kind']}\n")
            if len(defs) > 5:
                w.add(f"  … {len(defs) - 5} more definitions\n")
        total = f"{len(sites) + len(grep)} references in {len({r['rel_file'] for r in [*sites, *grep]})} files"
        total += f" ({len(grep)} of them text matches in files that are not parsed)" if grep else ""
        total += f"; {len(said)} other mentions (imports, strings, comments) listed last" if said else ""
        hidden = sum(r["status"] == "test" for r in first) + len(plain) - len(grep) + len(other) - len(said)
        total += f"; {hidden} more in tests (include_tests=true)" if hidden else ""
        away = sum(r["status"] == "elsewhere" for r in first)
        total += f"; {away} resolved to the other definitions" if away else ""
        w.add(total + (f" under {C.norm_path(path)}" if path else "") + "\n")

        def place(r) -> str:
            return f"in {r['scope']} [{r['span']}]" if r["scope"] else "module level"

        def site(r) -> str:
            head = f"{r['rel_file']}:{r['line']} {place(r)}\n"
            if context <= 0:
                return head + (f"  {line(r['rel_file'], r['line'])}\n" if line(r["rel_file"], r["line"]) else "")
            c = min(context, 3)
            return head + "".join(f" {'>' if n == r['line'] else ' '}{n} {line(r['rel_file'], n)}\n" for n in range(max(1, r["line"] - c), r["line"] + c + 1) if line(r["rel_file"], n) or n == r["line"])

        left = w.take([site(r) for r in sites], 50)
        left += w.take([f"{t['rel_file']}:{t['line']} (text)\n  {t['text']}\n" for t in grep], 50) if not left else len(grep)
        if depth > 1 and not left:
            left += self._deeper(w, rows, depth, place, line)
        if said:
            left += len(said) if left else self._mentions(w, said, line)
        if left:
            w.add(f"[truncated at max_tokens={w.most}: {left} more references not shown; narrow with path=, or raise max_tokens]\n")
        else:
            w.add(f"[complete: every reference{f' to depth {depth}' if depth > 1 else ''} is listed above]\n")
        return w.text()

    def _deeper(self, w: Budget, rows, depth: int, place, line) -> int:
        left = 0
        for d in range(2, depth + 1):
            asked: dict[str, object] = {}
            done = {r["name"] for r in rows if r["depth"] < d}
            for r in rows:
                if r["depth"] == d - 1 and r["status"] == "shown" and r["fn_name"]:
                    own = r["fn_name"]
                    if own in ("__init__", "constructor", "__new__"):
                        own = r["scope"].split(".")[0] if "." in r["scope"] else ""
                    if own and own not in done:
                        asked[own] = r
            if not asked:
                return left
            w.add(f"depth {d}: references to the {len(asked)} enclosing functions above (matched by name)\n")
            owners = {r["name"]: r["n"] for r in callers.def_files(self.tags).where(F.col("name").isin(*asked)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
            for name in sorted(asked, key=lambda n: (owners.get(n, 0) > 1, n)):
                mine = [r for r in rows if r["depth"] == d and r["name"] == name]
                shown = [r for r in mine if r["status"] == "shown"]
                vague = [r for r in mine if r["status"] == "ambiguous"]
                tests, away = (sum(r["status"] == s for r in mine) for s in ("test", "elsewhere"))
                head = f"{name} (from {asked[name]['rel_file']}:{asked[name]['fn_line']}): {len(shown)} references" + (f", {tests} in tests" if tests else "")
                if owners.get(name, 0) > 1:
                    head += f"; {owners[name]} files define {name} ({away} references resolved to them" + (f", {len(vague)} by-name matches elsewhere, probably other classes' {name}, listed last" if vague else "") + ")"
                if not w.fits(head + "\n", 50):
                    left += len(shown)
                    continue
                w.add(head + "\n")
                left += w.take([f"  {r['rel_file']}:{r['line']} {place(r)}: {line(r['rel_file'], r['line'])}\n" for r in shown], 50)
                if vague:
                    text = f"  other {name} (by name, not followed): " + ", ".join(f"{r['rel_file']}:{r['line']}" for r in vague) + "\n"
                    left += len(vague) if w.take([text], 50) else 0
        return left

    def _mentions(self, w: Budget, said, line) -> int:
        if not w.fits("other mentions:\n", 50):
            return len(said)
        w.add("other mentions (imports, strings, comments):\n")
        if len(said) <= 15:
            return w.take([f"  {m['rel_file']}:{m['line']}: {line(m['rel_file'], m['line'])}\n" for m in said], 50)
        by: dict[str, list[str]] = {}
        for m in said:
            by.setdefault(m["rel_file"], []).append(str(m["line"]))
        done = 0
        for f, nums in by.items():
            text = f"  {f}: {', '.join(nums)}\n"
            if not w.fits(text, 50):
                return len(said) - done
            w.add(text)
            done += len(nums)
        return 0

    def status(self) -> dict:
        tags = self.tags.count()
        return {"root": self.root, "tags": tags, "files": self.files.count(), "memory_bytes": tags * cache.BYTES_PER_TAG}


def _texts(files: DataFrame, root: str) -> DataFrame:
    """Contents of files no extractor reads, up to the size that is searched as text, without binaries."""
    import pandas as pd

    def read(frames):
        for pdf in frames:
            rows = []
            for rel in pdf["rel_file"]:
                try:
                    data = tree.read_regular(root, rel, callers.TEXT_GREP_MAX_BYTES)
                except (OSError, ValueError):
                    continue
                if b"\0" not in data[:8192]:
                    rows.append((rel, data))
            yield pd.DataFrame(rows, columns=["rel_file", "content"])

    small = files.where(~C.maybe_source(F.col("rel_file")) & (F.col("size") > 0) & (F.col("size") <= callers.TEXT_GREP_MAX_BYTES))
    return small.select("rel_file").mapInPandas(read, "rel_file string, content binary")
