"""A session over one corpus: requests in, spans out; edits in, versions out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as tx
from ..functions.locators import parse_line_range, parse_symbol_query, register
from ..operators import edits as ed
from ..operators import graph, pack, parse, read, search
from ..sources import files as fs
from ..sources.corpus import Corpus, prose_symbols, repo_outline
from ..sources.store import checkpoint
from .model import ApplyRequest, Edit, Query, Request
from .pending import Pending

HELP = (
    "modes: auto lexical structural graph semantic ast diagnose; "
    "details: locate outline snippet full refs impact context callgraph count tree diff ast import help; "
    "filters: path_scope lang all_of any_of none_of; lines: a-b a a- -n ~n; "
    "edits: new_body anchor/replace (word) rename move_to @after @before @into @end @new @delete undo"
)
SEEN_MOST = 50_000
#: Changed files whose diffs, and whose names, an answer has at most; the number of all is told.
DIFFS, NAMES = 60, 10_000


class Session:
    """Handles to the tables of a corpus at one revision.

    root: directory that edits are written to (none: tables only).  prose: lines are
    symbols where a language has no parser.  provider: of a name, its references and the
    files they are complete for (path, line; path), from a language server or compiler, or None."""

    def __init__(self, spark: SparkSession, corpus: Corpus, root: str | None = None, prose: bool = False, provider: Callable[[str], tuple[DataFrame, DataFrame] | None] | None = None):
        self.spark, self.root, self.prose, self.provider, self.revision = spark, root, prose, provider, 0
        register(spark)
        self.audit = fs.Audit()
        self.seen: set[str] = set()
        self.failed: dict[str, None] = {}  # the last RING of them
        rows = corpus.files.select("path", F.lit(0).cast("long").alias("revision"), "text", F.lit("put").alias("op"), F.lit(0).cast("long").alias("batch_id"))
        self.versions, self.corpus, self.last_diags = rows, corpus, None

    @classmethod
    def from_dir(cls, spark: SparkSession, root: str) -> Session:
        # a snapshot: plans must not read the tree again after it was edited
        files = checkpoint(fs.scan(spark, root))
        return cls(spark, Corpus(files, parse.code_symbols(files)), root)

    # Search.

    def plan(self, query, budget: int = 8000) -> DataFrame:
        """id, text, score of one query; the order of the cases decides what a query means."""
        q = Query.of(query)
        part = self.corpus.scoped(list(q.path_scope), q.lang)
        name = parse_symbol_query(q.q)[1]
        if q.detail == "help":
            return self._rows([("help", HELP, 1.0)])
        if q.mode == "diagnose":
            blob = self.spark.createDataFrame(list(enumerate(q.q.split("\n"))), "n long, text string")
            found = read.diagnose(blob, self.corpus)
            return found.select(F.concat("path", F.lit("@L"), F.col("line").cast("string")).alias("id"), F.concat_ws("\n", "severity", "message", "around").alias("text"), "score")
        if q.detail == "import":
            wanted = self.spark.createDataFrame([(name, q.path or "")], "name string, target string")
            rows = graph.imports(self.corpus, wanted).orderBy("definition").limit(20)
            return rows.select(F.concat("name", F.lit("@"), "definition").alias("id"), F.col("statement").alias("text"), F.lit(1.0).alias("score"))
        if q.detail == "impact":
            return self._reached(graph.impact(part, name))
        if q.detail == "context":
            rows = graph.context(part, name)
            return rows.select(F.concat("path", F.lit("#"), "name", F.lit("@L"), F.col("start").cast("string")).alias("id"), F.col("role").alias("text"), F.lit(1.0).alias("score"))
        if q.detail == "callgraph":
            return self._reached(graph.callgraph(part, name))
        if q.detail == "refs" or q.mode == "graph" and q.detail not in ("count", "tree"):
            rows = self._references(q, part, name).orderBy("path", "line").limit(6 * q.k)
            return rows.select(F.concat("path", F.lit("@L"), F.col("line").cast("string")).alias("id"), "text", F.lit(1.0).alias("score"))
        if q.detail == "count":
            if q.all_of or q.any_of or q.none_of:
                rows = search.count_boolean(part, q.all_of, q.any_of, q.none_of, q.q)
            elif not q.q:
                from ..sources.corpus import file_metrics

                rows = file_metrics(part).orderBy(F.desc("lines"), "path").limit(200)
            else:
                rows = search.count_matches(part, q.q)
            return rows.select(F.col("path").alias("id"), F.to_json(F.struct("*")).alias("text"), F.col("lines").cast("double").alias("score"))
        if q.detail == "tree":
            return read.tree(part.files).select(F.col("path").alias("id"), F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), "entry").alias("text"), F.lit(1.0).alias("score"))
        if q.detail == "diff":
            rows = ed.session_diff(self.versions, 0).limit(60).collect()
            return self._rows([(r["path"], ed.unified_diff(r["path"], r["old_text"] or "", r["new_text"] or ""), 1.0) for r in rows])
        if q.detail == "ast" or q.mode == "ast":
            return self._ast(part, q)
        if q.mode == "semantic":
            found = search.semantic(self.corpus, part, q.q, q.k)
            return self._shown(pack.normalise(found.withColumn("text", F.lit(""))).select("id", "score"), part, q)
        if q.path is None and q.detail == "outline" and not q.q:
            return repo_outline(part).select(F.col("path").alias("id"), F.array_join("outline", "\n").alias("text"), F.lit(1.0).alias("score"))
        if q.path is not None:
            return self._read(q, budget)
        if not q.q and not (q.all_of or q.any_of or q.none_of):
            return self._rows([])
        if q.mode == "lexical":
            hits = search.boolean_hits(part, q.all_of, q.any_of, q.none_of, q.q, q.k) if q.all_of or q.any_of or q.none_of else search.regex_hits(part, q.q, q.k)
            found = search.rrf((1.0, search.lexical_rank(part, hits)))
        elif q.mode == "structural":
            found = search.rrf((1.0, search.structural(part, q.q.strip())))
        else:
            found = search.search_auto(self.corpus, q.q, 256 if self.seen else q.k, part, q.all_of, q.any_of, q.none_of)
        if self.seen:
            known = self.spark.createDataFrame([(s,) for s in sorted(self.seen)], "id string")
            found = search.exclude_seen(found, known)
        return self._shown(found.orderBy(F.desc("score"), "id").limit(q.k), part, q)

    def code(self, request) -> str:
        """The envelope of a request: each query's share, without duplicates, packed and ordered."""
        req = Request.of(request)
        self.seen = self.seen if req.exclude_seen and len(self.seen) < SEEN_MOST else set()
        parts = []
        for i, q in enumerate(req.queries):
            rows = self.plan(q, req.budget_tokens).withColumn("q_idx", F.lit(i))
            parts.append(search.ranked(rows, F.desc("score"), "id"))
        spans = parts[0]
        for p in parts[1:]:
            spans = spans.unionByName(p)
        spans = spans.persist()
        if spans.isEmpty():
            q = req.queries[0]
            none = search.no_match_hint(self.corpus, self.corpus.scoped(list(q.path_scope), q.lang), q.q)
            spans.unpersist()
            return pack.error(none.code, f"{q.q} {json.dumps(none.near)} {'; '.join(none.hints)}")
        whole, n_found = spans, spans.count()
        shares = ""
        if len(req.queries) > 1:
            hits = {r["q_idx"]: r["hits"] for r in search.attribution(spans).collect()}
            shares = "\n" + "; ".join(f"{q.q or q.path or q.detail}: {hits.get(i, 0)}" for i, q in enumerate(req.queries))
            spans = pack.fair_share(spans, req.budget_tokens, len(req.queries))
        packed = pack.budget_pack(pack.dedup_spans(spans), req.budget_tokens)
        shown = pack.edge_order(pack.normalise(packed)).orderBy("place").select("id", "text", "score").persist()
        if req.exclude_seen:
            self.seen |= {r["id"] for r in shown.select("id").collect()}
        self.audit.record("code", "; ".join(q.q for q in req.queries))
        answer = pack.envelope(shown, req.budget_tokens, shown.count() < n_found) + shares
        for df in (shown, whole):
            df.unpersist()
        return answer

    def _rows(self, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, "id string, text string, score double")

    def _reached(self, rows: DataFrame) -> DataFrame:
        rows = rows.orderBy("depth", "path", "start", "name").limit(60)
        return rows.select(F.concat("path", F.lit("#"), "name", F.lit("@L"), F.col("start").cast("string")).alias("id"), F.concat(F.lit("depth "), F.col("depth").cast("string")).alias("text"), (1 / F.col("depth")).alias("score"))

    def _references(self, q: Query, part: Corpus, name: str) -> DataFrame:
        """References of a name; of PATH#NAME those in its package, if other files define the name too."""
        path = parse_symbol_query(q.q)[0]
        others = self.corpus.symbols.filter((F.col("name") == name) & (F.col("path") != F.lit(path or "")))
        if path and not others.isEmpty() and (root := self._package(path, self.corpus.files)):
            part = part.scoped([f"{root}/**"])
        found = self.provider(name) if self.provider else None
        return graph.tiered_references(part, name, *(found or ()))

    def _package(self, path: str, files: DataFrame) -> str | None:
        return graph.package_roots(self.spark.createDataFrame([(path,)], "path string"), files).first()["root"]

    def _ast(self, part: Corpus, q: Query) -> DataFrame:
        """Nodes of a kind in all files of the scope, or the tree of a file."""
        files = part.files if q.path is None else part.files.join(search.resolve_path(part.files, q.path), "path", "left_semi")
        if q.detail == "ast" and q.mode != "ast":
            lines = None
            if q.lines:
                total = files.agg(F.max(F.size(tx.lines(F.col("text"))))).first()[0] or 0
                lines = parse_line_range(q.lines, total)
            rows = parse.node_tree(files.orderBy("path").limit(q.k), lines)
            return rows.select(F.col("path").alias("id"), F.col("tree").alias("text"), F.lit(1.0).alias("score"))
        rows = parse.node_query(files, q.q, 4 * q.k)
        at = F.format_string("%s@L%d-%d", "path", "start", "end")
        return rows.select(F.concat(at, F.lit("."), F.col("ord").cast("string")).alias("id"), F.concat_ws(" ", "kind", "name").alias("text"), F.lit(1.0).alias("score"))

    def _shown(self, found: DataFrame, part: Corpus, q: Query) -> DataFrame:
        """Results with the text that the detail asks for."""
        s = part.located.withColumn("line", F.col("start"))
        own = found.join(s, "id", "left").withColumns({
            "path": F.coalesce("path", F.regexp_extract("id", r"^([^#@]+)", 1)),
            "start": F.coalesce("start", F.regexp_extract("id", r"@L([0-9]+)-", 1).cast("int")),
            "end": F.coalesce("end", F.regexp_extract("id", r"@L[0-9]+-([0-9]+)", 1).cast("int")),
        }).withColumn("line", F.coalesce("line", "start"))
        if q.detail == "outline":
            return own.select("id", F.coalesce("signature", F.lit("")).alias("text"), "score")
        if q.detail == "locate":
            return own.select("id", F.format_string("L%d-%d %s", "start", "end", F.coalesce(F.substring_index("body", "\n", 1), F.lit(""))).alias("text"), "score")
        if q.detail == "full":
            return own.join(part.files.select("path", F.col("text").alias("file")), "path").select("id", F.coalesce("body", F.element_at(tx.lines(F.col("file")), F.col("start"))).alias("text"), "score")
        shown = read.snippets(own.select("id", "path", "start", "end", "line"), part)
        return own.select("id", "score").join(shown, "id").select("id", F.col("snippet").alias("text"), "score")

    def _read(self, q: Query, budget: int) -> DataFrame:
        hit = search.resolve_path(self.corpus.files, q.path).first()
        if hit is None:
            near = [r["path"] for r in search.path_suggestions(self.corpus.files, q.path).collect()]
            return self._rows([(q.path, pack.error("PATH_NOT_FOUND", f"{q.path}; near: {near}"), 0.0)])
        path = hit["path"]
        if q.lines:
            rows = read.read_range(self.corpus, path, q.lines).orderBy("line")
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.concat(x["line"].cast("string"), F.lit("\t"), x["text"])), "\n")
            return rows.groupBy("path").agg(joined.alias("text")).select(F.col("path").alias("id"), "text", F.lit(1.0).alias("score"))
        if q.detail in ("outline", "locate"):
            one = Corpus(self.corpus.files, self.corpus.symbols.filter(F.col("path") == path))
            return repo_outline(one).select(F.col("path").alias("id"), F.array_join("outline", "\n").alias("text"), F.lit(1.0).alias("score"))
        return read.whole(self.corpus.files.filter(F.col("path") == path), budget).select(F.col("path").alias("id"), "text", F.lit(1.0).alias("score"))

    # Edits.

    def apply(self, request) -> dict:
        """Prepare every edit on what the ones before it left, check the whole, then commit;
        on an error nothing changes.

        Returns diffs by path (of the first DIFFS), the new revision, the paths, their number, and notes."""
        req = ApplyRequest.of(request)
        if req.run:
            raise ed.EditError("RUN_DISABLED", "commands are not run; pass their output to diagnose")
        if req.undo:
            changes = self._undo(req.undo)
        else:
            key = ed.signature_of({"edits": [asdict(e) for e in req.edits]})
            if key in self.failed:
                raise ed.EditError("REPEATED", "the same request failed before and nothing has changed since")
            try:
                changes = self._prepare(req.edits)
            except ed.EditError:
                self.failed = dict.fromkeys([*self.failed, key][-ed.RING :])
                raise
        changes = checkpoint(changes)
        n = changes.count()
        shown = changes.orderBy("path").limit(DIFFS).collect()
        diffs = {r["path"]: ed.unified_diff(r["path"], r["before"] or "", r["text"] or "") for r in shown}
        names = [r["path"] for r in changes.select("path").orderBy("path").limit(NAMES).collect()]
        notes = [] if req.undo else self._uses(req.edits)
        if not req.dry_run and n:
            self._commit(changes)
        self.audit.record("apply", f"{n} files{' (dry run)' if req.dry_run else ''}")
        return {"diffs": diffs, "revision": self.revision, "files": names, "n_files": n, "notes": notes}

    def _uses(self, edits: tuple[Edit, ...]) -> list[str]:
        """Who else depends on the symbols that got a new body."""
        names = sorted({parse_symbol_query(e.locator)[1] for e in edits if e.new_body is not None and "#" in e.locator and "@" not in e.locator.split("@L")[0]})
        return [f"{r['name']}: {r['n']} references in {r['files']} files" for r in graph.blast_radius(self.corpus, names).orderBy("name").collect()]

    def reindex(self, path: str | None = None) -> dict[str, int]:
        """Read the tree (or one file) again: what changed on disk becomes a new revision.

        Returns how many files were put and deleted; unchanged ones are not parsed again."""
        if not self.root:
            return {"put": 0, "deleted": 0}
        now, old = fs.scan(self.spark, self.root).select("path", "text"), self.corpus.files.select("path", F.col("text").alias("before"))
        both = now.join(old, "path", "full_outer").filter(~F.col("text").eqNullSafe(F.col("before")))
        changes = checkpoint((both.filter(F.col("path") == path) if path else both).select("path", "text", "before"))
        n = changes.agg(F.count("text").alias("put"), F.count_if(F.col("text").isNull()).alias("deleted")).first().asDict()
        if n["put"] or n["deleted"]:
            self._commit(changes, write=False)
        return n

    def _prepare(self, edits: tuple[Edit, ...]) -> DataFrame:
        """path, text, before of all files that the edits change."""
        now = Pending(self.corpus.files)
        for e in edits:
            self._edit(e, now)
        changes = now.changes()
        if self.root:
            box = fs.Sandbox(self.root)
            for r in changes.select("path").toLocalIterator():
                if why := box.check(r["path"]):
                    raise ed.EditError("DENIED", f"{why}: {r['path']}")
        return changes

    def _edit(self, e: Edit, now: Pending) -> None:
        if e.lazy_edit is not None:
            raise ed.EditError("NOT_ENABLED", "lazy_edit")
        head = e.locator.split(" :: ")[0]
        verb = head.rsplit("@", 1)[1] if "@" in head and not head.rsplit("@", 1)[1].startswith("L") else ""
        head = head[: -len(verb) - 1] if verb else head
        path, name = parse_symbol_query(head)
        path, name = (path, name) if path else (name, "")
        start = int(head.rsplit("@L", 1)[1].split("-")[0]) if "@L" in head else None
        if e.path_scope and e.anchor is not None:
            old, new = e.anchor, e.replace or ""
            self._checked(now.change_all(F.replace("text", F.lit(old), F.lit(new)), ed.bulk_where(list(e.path_scope), old), e.force))
            return
        if verb == "new":
            if now.find(path) is not None:
                raise ed.EditError("EXISTS", path)
            now.put(path, e.new_body or "")
            return
        text, lang = now.file(path)
        self._guard_generated(path, e)
        if e.rename and name:
            self._rename(path, name, lang, e, now)
            return
        if verb == "delete" and not name:
            now.put(path, None)
            return
        span = ed.resolve_span(text, lang, name, start) if name else None
        if span and " :: " in e.locator and not e.locator.endswith(self._hash(span.body)):
            raise ed.EditError("STALE", e.locator)
        if verb == "delete":
            if not e.force and (uses := graph.references(Corpus(now.files, self.corpus.symbols), span.name).limit(2).collect()):
                uses = [u for u in uses if u["path"] != path or not span.start <= u["line"] <= span.end]
                if uses:
                    raise ed.EditError("STILL_USED", f"{span.name} in {uses[0]['path']}")
            new = ed.delete_symbol(text, span)
        elif verb:
            new = ed.insert(text, verb, e.new_body or "", span)
        elif e.move_to:
            there = now.find(e.move_to)
            body = "\n".join(text.split("\n")[ed.leading_start(text.split("\n"), span.start) - 1 : span.end])
            target = there[0] if there else ""
            now.put(e.move_to, ed.insert(target, "end", ("\n" if target.strip() else "") + body))
            new = ed.delete_symbol(text, span)
        elif e.anchor is not None and e.word and span:
            body, n = ed.replace_word(span.body, e.anchor, e.replace or "", lang)
            if not n:
                raise ed.EditError("ANCHOR_NOT_FOUND", e.anchor)
            new = ed.replace_body(text, span, body)
        elif e.anchor is not None:
            new = ed.replace_anchor(text, e.anchor, e.replace or "", span)
        elif e.new_body is not None:
            new = ed.replace_body(text, span, e.new_body) if span else e.new_body
        else:
            raise ed.EditError("EMPTY_EDIT", e.locator)
        ed.check(path, new, lang, text)
        now.put(path, new)

    def _checked(self, changed: DataFrame) -> None:
        if row := ed.unreadable(changed).first():
            raise ed.EditError("PARSE_ERROR", row["path"])

    def _hash(self, body: str) -> str:
        import hashlib

        return hashlib.sha256(body.encode()).hexdigest()[:16]

    def _guard_generated(self, path: str, e: Edit) -> None:
        if not e.force and self.spark.range(1).select(paths.is_generated(F.lit(path)).alias("x")).first()["x"]:
            raise ed.EditError("GENERATED", path)

    def _rename(self, path: str, name: str, lang: str, e: Edit, now: Pending) -> None:
        """All whole-word occurrences in code, in the languages of the definition's family, in its package if several define the name."""
        new = ed.new_name(e.rename)
        homes = self.corpus.symbols.filter(F.col("name") == name).select("path").distinct()
        if not e.force and not self.corpus.symbols.filter(F.col("name") == new).isEmpty():
            raise ed.EditError("NAME_TAKEN", new)
        where = (paths.family(F.col("lang")) == paths.family(F.lit(lang))) & F.contains("text", F.lit(name))
        if not homes.filter(F.col("path") != path).isEmpty():
            base = self._package(path, now.files)
            roots = graph.package_roots(homes.filter(F.col("path") != path), now.files)
            if base is None or not roots.filter(F.col("root").eqNullSafe(F.lit(base))).isEmpty():
                some = [r["path"] for r in homes.orderBy("path").limit(8).collect()]
                raise ed.EditError("AMBIGUOUS", f"{name} is defined in {', '.join(some)}")
            where = where & F.col("path").startswith(f"{base}/") if base else where
        self._checked(now.change_all(ed.renamed(name, new)("text", "lang")["text"], where, e.force))

    def _undo(self, n: int) -> DataFrame:
        then = ed.undo(self.versions, n, self.revision + 1).filter(F.col("revision") == self.revision + 1).select("path", "text")
        return then.join(self.corpus.files.select("path", F.col("text").alias("before")), "path", "left")

    def _commit(self, changes: DataFrame, write: bool = True) -> None:
        """changes: path, text (null: deleted), before; one row per path, written out."""
        if self.root and write:
            fs.Sandbox(self.root).commit((r["path"], r["text"]) for r in changes.select("path", "text").toLocalIterator())
        batch = self.versions.agg(F.max("batch_id")).first()[0] + 1
        self.revision += 1
        self.versions = checkpoint(ed.upsert(self.versions, changes.select("path", "text"), self.revision, batch))
        self.failed.clear()
        old, names = self.corpus, changes.select("path")
        # a file keeps its language; a new one has that of its name and text
        was = old.files.select("path", F.col("lang").alias("was"))
        fresh = changes.filter("text is not null").join(was, "path", "left")
        fresh = checkpoint(fresh.select("path", "text", F.coalesce("was", paths.language(F.col("path"), F.col("text"))).alias("lang")))
        files = checkpoint(old.files.select("path", "text", "lang").join(names, "path", "left_anti").unionByName(fresh))
        symbols = prose_symbols(fresh) if self.prose else parse.code_symbols(fresh)
        # symbols of files that did not change are kept
        kept = old.symbols.join(names, "path", "left_anti")
        self.corpus = Corpus(files, checkpoint(kept.unionByName(symbols.select(*kept.columns))))

    # Reports.

    def status(self) -> dict:
        langs = {r["lang"]: r["count"] for r in self.corpus.files.groupBy("lang").count().collect()}
        return {"revision": self.revision, "files": sum(langs.values()), "languages": langs, "references": "lsp" if self.provider else "lexical-approx", "symbols": self.corpus.symbols.count(), "calls": len(self.audit.entries), "help": HELP}

    def repo_map(self, budget: int = 2000, min_name_len: int = 3) -> str:
        edges = graph.reference_edges(self.corpus, min_name_len)
        rows = graph.repo_map(self.corpus, graph.pagerank(self.corpus.files, edges), budget).orderBy(F.desc("rank"), "path").collect()
        return "\n".join(f"{r['path']}\n" + "\n".join(f"  {x}" for x in r["names"].split("\n")) for r in rows)

    def project(self) -> dict[str, str]:
        """Usual commands by the path of a manifest, at the top or in folders; they are named, not run."""
        known = {"Cargo.toml": "cargo test", "go.mod": "go test ./...", "pubspec.yaml": "dart test", "pyproject.toml": "pytest", "setup.py": "pytest", "package.json": "npm test", "pom.xml": "mvn test"}
        name = F.element_at(F.split("path", "/"), -1)
        rows = self.corpus.files.filter(name.isin(list(known))).select("path", name.alias("name")).orderBy(F.size(F.split("path", "/")), "path").limit(NAMES).collect()
        return {r["path"]: known[r["name"]] for r in rows}

