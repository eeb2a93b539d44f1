"""The engine: builds an index of a source tree (or any table of files) and answers its queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import blockmax, cells, clusters, graph, lookup, positions, postings, ranking, retrieval, rules
from ..sources import files as tree
from ..sources import structure
from .activity import SearchCounters
from .generations import BUCKET_ROWS, BUCKETS, CORE, STAGES, Manifest, Store, reuse, touched_buckets, validate

#: Postings of about so many chunks or identifiers make a block.
BLOCK = 128


@dataclass
class Providers:
    """How texts become vectors: for columns on the executors, and for a query on the driver."""

    name: str = "mock"
    column: object = staticmethod(vectors.mock_vector)
    query: object = staticmethod(vectors.mock_embed)


class Engine:
    def __init__(self, spark: SparkSession, store: str, providers: Providers | None = None) -> None:
        self.spark, self.store, self.providers = spark, Store(spark, store), providers or Providers()
        self.counters = SearchCounters()

    # Building

    def index(self, root: str | DataFrame, mode: str = "full", since: int = 0) -> list[tuple[str, str]]:
        """Builds and validates a pending generation and makes it active; on failure it is cleared. since: a generation
        from which rows of unchanged files are taken over."""
        with self.store.lock():
            return self._index(root, mode, since)

    def _index(self, root: str | DataFrame, mode: str, since: int, start: str | None = None) -> list[tuple[str, str]]:
        g = self.store.reserve()
        try:
            self._build(root, g, mode, since, start)
            issues = validate(self.store, g, mode)
            if issues:
                raise RuntimeError("; ".join(f"{c}: {m}" for c, m in issues))
            self.store.activate(g)
            return []
        except Exception:
            self.store.clear_pending()
            raise

    def _build(self, root: str | DataFrame, g: int, mode: str, since: int = 0, start: str | None = None) -> None:
        """since: the generation that unchanged files' rows come from; start: the first stage that is built anew, those
        before it being that generation's own."""
        made = Manifest(g, mode, provider=self.providers.name, since=since)
        was = self.store.manifest(since) if since else None
        frames: dict[str, DataFrame] = {}
        same = fresh = touched = None  # paths of unchanged files, the files to read anew, and the buckets with a change

        def done(name: str) -> DataFrame:
            frames[name] = self.store.read(made, g, name)
            made.tables[name] = frames[name].count()
            return frames[name]

        def put(name: str, df: DataFrame, by: str | None = None) -> DataFrame:
            """A table of this generation; sorted by what it is looked up by, if told."""
            self.store.save(g, name, df.repartitionByRange(by).sortWithinPartitions(by) if by else df)
            return done(name)

        def per_file(name: str, build) -> DataFrame:
            """A table whose rows come from one file each: build makes those of the files given. Buckets of files without a change
            are the earlier generation's own; in the others rows of unchanged files are taken over."""
            if same is None:
                self.store.save_parts(made, name, build(frames["files"]))
                return done(name)
            kept = self.store.read(was, since, name, touched).join(same, "path", "left_semi")
            self.store.save_parts(made, name, kept.unionByName(build(fresh)), "path", touched, self.store.shared_folders(was, name, touched))
            table = done(name)
            made.reused[name] = made.tables[name] - table.join(fresh.select("path"), "path", "left_semi").count()
            return table

        def delta(name: str, key: str, affected: DataFrame | None, build) -> DataFrame:
            """A table derived from several files: build makes the rows of the affected keys, all others stay as they were."""
            if same is None:
                self.store.save_parts(made, name, build(lambda df: df), key)
                return done(name)
            where = touched_buckets(affected, made.buckets, key)
            only = lambda df: df.join(affected, key, "left_semi")
            kept = self.store.read(was, since, name, where).join(affected, key, "left_anti")
            self.store.save_parts(made, name, kept.unionByName(build(only)), key, where, self.store.shared_folders(was, name, where))
            table = done(name)
            made.reused[name] = made.tables[name] - only(table).count()
            return table

        embed = self.providers.column
        source = tree.read_tree(self.spark, root) if isinstance(root, str) else root
        every = [*STAGES] if mode == "full" else [*CORE]
        for stage in every:
            if start and every.index(stage) < every.index(start):
                for table in STAGES[stage][1]:
                    self.store.adopt(made, was, table)
                    frames[table] = self.store.read(made, g, table)
                made.buckets, made.stages[stage] = was.buckets, "completed"
                continue
            if any(made.stages.get(d) != "completed" for d in STAGES[stage][0]):
                raise RuntimeError(f"{stage} needs {STAGES[stage][0]}")
            if stage == "bootstrap":
                f = source.dropDuplicates(["path"])
                told = f.select("path", "content", "size", "mtime_ms", text.content_hash(F.col("content")).alias("hash"), text.directory(F.col("path")).alias("module"), tree.language(F.col("path")).alias("language"), tree.header(F.col("content")).alias("header"))
                put("files", told, "path")
                made.buckets = was.buckets if was else max(BUCKETS, -(-made.tables["files"] // BUCKET_ROWS))
                if since and not start:
                    before = self.store.read(was, since, "files")
                    kept, fresh = reuse(before, frames["files"], ["path", "hash"], [])
                    same = kept.select("path")
                    gone = before.select("path").join(same, "path", "left_anti")
                    touched = touched_buckets(fresh.select("path").unionByName(gone), made.buckets)
                put("path_grams", positions.gram_positions(frames["files"]), "gram")
            elif stage == "file-search":
                symbols = per_file("symbols", lambda f: structure.parse_symbols(f).dropDuplicates(["path", "name", "line"]))
                per_file("symbol_tokens", lambda f: lookup.symbol_tokens(symbols.join(f.select("path"), "path", "left_semi")))
                search = F.concat_ws(" ", "path", "header", F.array_join("symbols", " "), "content")
                per_file("file_docs", lambda f: tree.source_documents(f, symbols).unionByName(tree.text_documents(f)).dropDuplicates(["path"]).withColumn("vector", embed(search)))
            elif stage == "identifier-search":
                per_file("identifiers", lambda f: self._identifiers(f, frames["symbols"]).withColumn("vector", embed(F.col("text"))))
                ids = frames["identifiers"].withColumn("lexical_text", postings.identifier_text())
                own = lambda df, f: df.join(f.select("path"), "path", "left_semi")
                per_file("identifier_postings", lambda f: self._postings(own(ids, f)))
                put("identifier_blocks", self._blocks(frames["identifier_postings"], made.tables["identifiers"]), "term")
                per_file("word_hits", lambda f: lookup.word_hits(own(frames["symbols"], f), f, own(frames["identifiers"], f)))
                lines = per_file("source_lines", lambda f: structure.source_lines(f).select("path", "line", F.col("text").alias("content")))
                put("word_positions", positions.word_positions(lines), "word")
            else:
                moved = None
                if same is not None:
                    was_deps = self.store.read(was, since, "deps")
                    new = fresh.select("path").join(before.select("path"), "path", "left_anti")
                    moved = (fresh.select("path").unionByName(gone), new.unionByName(before.select("path").join(frames["files"].select("path"), "path", "left_anti")), was_deps)
                self._artifacts(frames, put, per_file, delta, moved)
            made.stages[stage] = "completed"
        self.store.save_manifest(made)

    @staticmethod
    def _identifiers(files: DataFrame, symbols: DataFrame) -> DataFrame:
        ids = symbols.join(files.select("path", "header"), "path")
        told = F.concat_ws(" ", "name", "kind", "signature", "parent_name", "path", "header")
        return ids.select(F.concat_ws(":", "path", "name", "line").alias("id"), "path", "header", "name", "kind", "line", "end_line", "signature", "parent_name", told.alias("text")).dropDuplicates(["id"])

    @staticmethod
    def _postings(texts: DataFrame) -> DataFrame:
        """Term counts of texts (id, path, lexical_text), with the path that they come from."""
        return postings.term_frequencies(texts, "id", F.col("lexical_text")).join(texts.select("id", "path"), "id")

    @staticmethod
    def _blocks(posted: DataFrame, n: int) -> DataFrame:
        """Posting blocks; what a folder holds lies in one block, or in a few where it is large."""
        folder = F.xxhash64(text.directory(F.col("path")))
        return blockmax.posting_blocks(posted, F.pmod(folder + F.pmod(F.xxhash64("path"), F.lit(4)), F.lit(max(1, -(-n // BLOCK)))))

    def _artifacts(self, frames: dict[str, DataFrame], put, per_file, delta, moved) -> None:
        """moved: of a refresh, the paths that changed, those that came or went, and the dependencies before; else None."""
        f, symbols = frames["files"], frames["symbols"]
        embed = self.providers.column
        own = lambda df, files: df.join(files.select("path"), "path", "left_semi")
        per_file("chunks", lambda files: postings.chunks(files, own(symbols, files)).withColumn("lexical_text", postings.chunk_text()).withColumn("vector", embed(F.col("lexical_text"))))
        per_file("postings", lambda files: self._postings(own(frames["chunks"], files)))
        put("posting_blocks", self._blocks(frames["postings"], frames["chunks"].count()), "term")
        imports = per_file("imports", lambda files: structure.imports(structure.source_lines(files)))
        exports = per_file("exports", lambda files: structure.exports(structure.source_lines(files)))
        calls = per_file("calls", lambda files: structure.calls(structure.source_lines(files)))
        importers = modules_of = near = None
        if moved:
            # Imports mean other files where their own file changed, or one of the paths that they could mean came or went.
            changed, turned, was_deps = moved
            could = imports.select("path", F.explode(graph.import_candidates(F.col("path"), F.col("source"))).alias("candidate"))
            meant = could.join(turned.select(F.col("path").alias("candidate")), "candidate", "left_semi").select("path")
            importers = changed.select("path").unionByName(meant).distinct()
            modules_of = importers.select(text.directory(F.col("path")).alias("module")).distinct()
        deps = delta("deps", "path", importers, lambda only: graph.resolve_imports(only(imports), f).select("path", "dep").distinct())
        delta("modules", "module", modules_of, lambda only: graph.module_summary(only(f), deps, symbols))
        delta("module_edges", "path", importers, lambda only: graph.module_import_edges(only(deps), f))
        if moved:
            ends = was_deps.unionByName(deps).join(importers, "path", "left_semi").select(F.col("dep").alias("path"))
            near = importers.unionByName(ends).distinct()
        per_path, per_symbol = ranking.structure_texts(f, symbols, deps, imports, exports, calls)
        put("file_structure", per_path, "path")
        put("symbol_structure", per_symbol, "path")
        docs = frames["file_docs"]
        code = docs.where(tree.navigable(F.col("path"))).select("path", "vector")
        knn = cells.knn_cells(code.withColumnRenamed("path", "id")).withColumnRenamed("id", "path")
        put("related", graph.related_contexts([
            (knn, "cluster", None),
            (deps.select("path", F.col("dep").alias("related")), "dependency", 0.72),
            (deps.select(F.col("dep").alias("path"), F.col("path").alias("related")), "reverse-dependency", 0.78),
            (graph.module_peers(f.select("path", "module"), 8).withColumnRenamed("peer", "related"), "module-peer", 0.58),
        ]))
        put("cluster_nodes", clusters.hierarchy(code))
        hubs = put("hubs", tree.hubs(f).withColumn("search_text", F.concat_ws(" ", "hub", "title", "content")).withColumn("vector", embed(F.col("search_text"))))
        put("hub_grams", positions.hub_grams(hubs), "gram")
        put("hub_links", tree.wiki_links(hubs, "hub").select(F.col("id").alias("hub"), "target", "description", "pos"))

        def cards(only) -> DataFrame:
            """Cards of files from the edges at both of their ends."""
            mine = only(f.select("path", "module", "header"))
            at_target = only(deps.select(F.col("dep").alias("path"), F.col("path").alias("dep"))).select(F.col("dep").alias("path"), F.col("path").alias("dep"))
            edges = only(deps).select("path", "dep").unionByName(at_target).distinct()
            n = only(symbols).groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))
            sized = mine.join(n, "path", "left").fillna(0, ["n_symbols"])
            told = ranking.file_cards(sized, graph.file_risk(mine, edges, only(exports))).join(ranking.api_card(only(exports), mine), "path")
            return told.join(ranking.neighbourhood_cards(sized, edges, only(frames["calls"].select("path", "callee"))), "path")

        delta("cards", "path", near, cards)
        of_module = lambda df, name: df.join(f.select("path", "module"), "path").groupBy("module").agg(F.count(F.lit(1)).alias(name))
        modules = f.groupBy("module").agg(F.count(F.lit(1)).alias("n_files")).join(of_module(symbols, "n_symbols"), "module", "left")
        modules = modules.join(of_module(graph.exported_symbols(symbols, exports), "n_exports"), "module", "left").fillna(0, ["n_symbols", "n_exports"])
        put("module_cards", ranking.module_cards(modules, frames["module_edges"]))
        put("ownership", graph.ownership_edges(symbols))

    def refresh(self, root: str | DataFrame, mode: str = "full") -> list[tuple[str, str]]:
        """A new generation in which only new and changed files are read, parsed and embedded anew; rows of the others, by
        path and content hash, are taken over from the active one if the same provider built it as widely, and what
        depends on several files is derived again. The active one serves until the new one is valid."""
        p = self.store.pointer()
        m = self.store.manifest(p.active) if p.active else None
        usable = m and m.provider == self.providers.name and (mode == "core" or m.mode == "full") and not validate(self.store, p.active, mode)
        return self.index(root, mode, p.active if usable else 0)

    def repair(self, root: str | DataFrame, target: str = "full") -> list[tuple[str, str]]:
        """Issues of the active generation before the repair. A broken or blocked one is built anew: whole, or where a stage
        is named and all issues are of its tables or of later ones, from that stage on, over the tables that the
        stages before it have. A valid one is left alone."""
        if target not in ("full", "core", *STAGES):
            raise ValueError(f"{target} is no stage")
        issues = self.check("core" if target in ("core", *CORE) else "full")
        if not issues:
            return issues
        order = [*STAGES]
        active, start = self.store.pointer().active, None
        if target in order[1:] and all(code in ("missing-table", "row-count-mismatch") for code, _ in issues):
            earlier = {t for stage in order[: order.index(target)] for t in STAGES[stage][1]}
            start = None if any(message.split()[0] in earlier for _, message in issues) else target
        if start:
            with self.store.lock():
                self._index(root, self.store.manifest(active).mode, active, start)
        else:
            self.index(root)
        return issues

    # Queries. Each reads the active generation only.

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    def check(self, mode: str = "full") -> list[tuple[str, str]]:
        return validate(self.store, self.store.pointer().active, mode)

    def require(self, mode: str = "full") -> None:
        """Raises where the active generation is not fresh or not whole. Its rows were checked when it was published."""
        if issues := validate(self.store, self.store.pointer().active, mode, scan=False):
            raise RuntimeError("the index is not valid: " + "; ".join(f"{c}: {m}" for c, m in issues))

    def symbol(self, query: str, k: int = 10, kinds: list[str] | None = None) -> DataFrame:
        return lookup.lookup_symbol(self._t("symbol_tokens"), query, k, kinds)

    def path(self, query: str, k: int = 10) -> DataFrame:
        return positions.lookup_path(self._t("files").select("path"), self._t("path_grams"), query, k)

    def word(self, query: str, k: int = 10, kinds: list[str] | None = None) -> DataFrame:
        tokens = list(dict.fromkeys([query.strip().lower(), *text.query_terms(query, text.EXACT)]))
        return lookup.lookup_word(self._t("word_hits"), tokens, k, kinds)

    def path_content(self, query: str) -> DataFrame:
        """The first file that the path lookup finds, with its indexed content: path, content; no row for none."""
        first = [r.path for r in self.path(query, 1).collect()]
        return self._t("files").where(F.col("path").isin(first)).select("path", "content")

    def exact(self, query: str, kind: str = "mixed", k: int = 10, kinds: list[str] | None = None) -> dict[str, DataFrame]:
        """Exact search: symbols for 'symbol', files for 'file', and both with word hits for 'mixed'."""
        found = {"symbols": lambda: self.symbol(query, k, kinds), "files": lambda: self.path(query, k), "words": lambda: self.word(query, k, kinds)}
        asked = {"symbol": ["symbols"], "file": ["files"], "mixed": [*found]}[kind]
        return {name: found[name]() for name in asked}

    def outline(self, path: str) -> DataFrame:
        if not self._t("files").where(F.col("path") == path).limit(1).count():
            raise LookupError(f"no file {path}")
        return lookup.outline(self._t("symbols"), path)

    def deps(self, target: str) -> DataFrame:
        found = [r.path for r in self.path(target, 5).collect()]
        if not found:
            raise LookupError(f"no file matches {target}")
        edges = self._t("deps")
        known = {r.path for r in edges.where(F.col("path").isin(found)).select("path").union(edges.where(F.col("dep").isin(found)).select("dep")).distinct().collect()}
        return lookup.dependency_info(edges, next((p for p in found if p in known), found[0]))

    def search(self, query: str, intent: str = "related", kind: str = "mixed", mode: str = "both", k: int = 5, kinds: list[str] | None = None, entity_types: list[str] | None = None) -> DataFrame:
        """intent 'exact': symbols or, for kind 'file', paths; 'related': the unified ranking."""
        if intent == "exact":
            return self.path(query, k) if kind == "file" else self.symbol(query, k, kinds)
        self.require()
        m = self.store.manifest(self.store.pointer().active)  # one generation from start to end
        return ranking.unified_search(lambda name: self.store.read(m, m.generation, name), query, self.providers.query(query), mode, k, kinds, entity_types)

    def diagnose(self, query: str, k: int = 5) -> dict[str, dict[str, int]]:
        """What a search of k results meets in each lane of postings, which `counters` adds up: lexical candidates, those
        ranked again and results."""
        lanes = {"chunk": "postings", "identifier": "identifier_postings"}
        found = {lane: retrieval.search_counts(self._t(name), query, k).first().asDict() for lane, name in lanes.items()}
        for lane, counts in found.items():
            self.counters.add(lane, counts)
        return found

    def research(self, query: str, k: int = 5, related: int = 6, hubs: int = 4) -> dict[str, DataFrame]:
        """Ranked hits with cards, related files, modules and hubs; tables, for any presentation."""
        hits = self.search(query, k=k).select("path", "title", "score", "entity_type")
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # at most k rows
        cards = self._t("cards")
        h = self._t("hubs")
        links = self._t("hub_links").select(F.col("hub").alias("id"), F.col("target").alias("path"))
        return {
            "hits": hits,
            "cards": cards.join(F.broadcast(hits.groupBy("path").agg(F.max("score").alias("score"))), "path").orderBy(F.desc("score"), "path"),
            "related": ranking.related_hits(hits, self._t("related"), related),
            "modules": ranking.module_hits(hits, cards.select("path", "module")),
            "hubs": ranking.overlap_score(h.select(F.col("hub").alias("id"), F.col("search_text").alias("text")), links, hits, query, 0.6, 0.4).orderBy(F.desc("score"), "id").limit(hubs),
        }

    def blast_radius(self, name: str, defined_in: str | None = None) -> DataFrame:
        kinds = [r.kind for r in self._t("symbols").where(F.col("name") == name).select("kind").distinct().collect()]
        return positions.blast_radius(self._t("word_positions"), self._t("source_lines"), name, defined_in, bool(kinds) and set(kinds) <= {"function", "method"})

    def call_sites(self, names: list[str], query: str, n: int = 10) -> DataFrame:
        """The best n using lines of each of the names, by the query's terms and vectors of the lines."""
        symbols = self.spark.createDataFrame([(name, name) for name in names], "symbol_id string, name string")
        return positions.call_sites(symbols, self._t("word_positions"), self._t("source_lines"), query, n, self.providers.query(query), self.providers.column(F.col("content")))

    def find_hub(self, name: str | None = None, query: str | None = None, mode: str = "both", show_orphans: bool = False) -> DataFrame:
        if show_orphans:
            return graph.orphans(self._t("files").select("path"), self._t("hub_links").select(F.col("target").alias("path")))
        if name:
            return positions.find_hub(self._t("hubs"), self._t("hub_grams"), name)
        return ranking.rank_hubs(self._t("hubs"), query, self.providers.query(query), mode) if query else self._t("hubs").orderBy("hub")

    def expand_hub(self, hub: str) -> DataFrame:
        """Links of one hub in order, each with whether its file is indexed, and the header and symbols of those that are."""
        links = self._t("hub_links").where(F.col("hub") == hub)
        told = graph.resolve_links(links, self._t("files").select("path", "header"))
        names = self._t("symbols").groupBy("path").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 5).alias("symbols"))
        return told.join(names, told["target"] == names["path"], "left").select("hub", "pos", "target", "description", "resolved", "header", "symbols").orderBy("pos")

    def suggestions(self, k: int = 4) -> dict[str, DataFrame]:
        """Hub suggestions from the clusters: members, labels with their slugs, tags, groups and links between them."""
        nodes = self._t("cluster_nodes").select(F.col("node").alias("suggestion"), "path")
        code = nodes.where(tree.navigable(F.col("path")))
        labels = clusters.suggestion_labels(code)
        headers = self._t("files").select("path", tree.feature_tag(F.col("content")).alias("tag"))
        tags = clusters.feature_tags(code.join(headers, "path").where("tag is not null").select("suggestion", "tag"))
        groups = clusters.feature_groups(tags, code, labels.select("suggestion", "label"))
        return {"members": code, "labels": labels, "tags": tags, "groups": groups, "links": clusters.suggestion_links(code, self._t("related").select("path", "related"), k)}

    def clusters(self) -> DataFrame:
        n = self._t("cluster_nodes")
        return n.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("n_files"), text.path_pattern(F.col("path")).alias("pattern")).orderBy("node")

    def navigate(self, max_depth: int = 3, max_clusters: int = 20) -> str:
        """The cluster tree as text: at most max_clusters children of a node, and of a node that is not opened at most
        max_clusters files (5 at least), with how many more there are. Only what is shown reaches the driver."""
        shown = max(max_clusters, 5)
        parts = F.slice(F.split("node", "/"), 1, max_depth + 1)
        n = self._t("cluster_nodes").select("path", F.array_join(parts, "/").alias("node"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("path"))
        files = n.withColumn("rank", rank).where(F.col("rank") <= shown).groupBy("node").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        sizes = n.groupBy("node").agg(F.count(F.lit(1)).alias("n"), text.path_pattern(F.col("path")).alias("pattern"))
        leaves = {r.node: r for r in sizes.join(files, "node").orderBy("node").collect()}  # nodes to max_depth
        children: dict[str, list[str]] = {}
        for node in leaves:
            steps = node.split("/")
            for i in range(1, len(steps)):
                above, here = "/".join(steps[:i]), "/".join(steps[: i + 1])
                if here not in children.setdefault(above, []):
                    children[above].append(here)
        out = [f"{sum(r.n for r in leaves.values())} files by meaning"]

        def told(node: str, level: int) -> None:
            pad, below = "  " * level, children.get(node, [])
            if level:
                r = leaves.get(node)
                out.append(f"{pad}[{(r and r.pattern) or node}]")
            if node in leaves:
                out.extend(f"{pad}  {p}" for p in leaves[node].paths)
                if leaves[node].n > shown:
                    out.append(f"{pad}  ... {leaves[node].n - shown} more files")
            for child in below[: max(1, max_clusters)]:
                told(child, level + 1)
            if len(below) > max(1, max_clusters):
                out.append(f"{pad}  ... {len(below) - max(1, max_clusters)} more clusters")

        if leaves:
            told("0", 0)
        return "\n".join(out)

    def lint(self) -> DataFrame:
        return rules.file_scores(rules.findings(self._t("files")))

    def tree(self, symbols: bool = True, max_tokens: int = 20_000) -> str:
        """An outline of the files; symbols, then headers are left out until it fits."""
        rows = self._t("files").select("path", "header").orderBy("path")
        names = self._t("symbols").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))).alias("s"))
        got = rows.join(names, "path", "left").orderBy("path").collect()
        for level in (2, 1, 0) if symbols else (1, 0):
            out = []
            for r in got:
                out.append(r.path + (f"  {r.header}" if level and r.header else ""))
                out += [f"  {s.kind} {s.name} :{s.line}" for s in (r.s or [])] if level == 2 else []
            found = "\n".join(out)
            if -(-len(found) // 4) <= max_tokens:
                break
        return found
