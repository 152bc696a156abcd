"""Hybrid search over a table of queries.

Every step is keyed by ``query_id``; one call answers the whole query table from a written store (``search_store``). No step
reads or tokenises the corpus: the text list comes from the inverted index, the vector list from packed vectors, tag-only
and match-all lists from bitmaps and the store order, and only the final rows meet their display fields.

Plan per mode (I2):
  hybrid  (loose text)      text list (conjunct of phrases + match) ‖ vector list -> RRF
  text    (phrases only)    text list ordered by BM25
  tags    (tags only)       tag clauses are the query; store order (seq)
  all     (nothing)         every non-excluded document in store order
Tag filters and exclusions are masks under every list, so nothing is scored that they exclude. The search limit is applied
before moderation (so fewer rows may come back), and rank counts the survivors. Scores are ranked as rounded to six
decimals, ties to smaller ids.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopdex.config import SearchConfig
from loopdex.functions.moderation import display_description, display_score, has_blocked_tag, is_removed
from loopdex.functions.query import exclusion_clause_tokens, tag_clause_tokens, with_parsed
from loopdex.operators import inverted
from loopdex.operators.embedder import Embedder, embed
from loopdex.operators.lists import top_lists, top_vectors, with_asks
from loopdex.operators.search_store import SearchStore, nearest, write_store
from loopdex.operators.tag_bitmaps import Masks, browse, filters, masks
from loopdex.operators.util import bounded_broadcast, ensure_cols, round6, top_k_per_group
from loopdex.session import scratch, written

#: Queries with the same rows that a task deals them to.
QUERIES_A_DEAL = 4096


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Parsed queries with clause token lists: req (tag filters) and neg (exclusions)."""
    p = with_parsed(queries)
    return p.withColumns({
        "req": F.transform("tags", tag_clause_tokens),
        "neg": F.transform("neg_tags", exclusion_clause_tokens),
    })


def query_masks(pq: DataFrame, store: SearchStore, cfg: SearchConfig) -> Masks:
    """The documents that each query's tag clauses and the blocked tags leave."""
    asked, of = filters(pq)
    blocked = F.array(*[exclusion_clause_tokens(F.lit(t)) for t in cfg.blocked_tags]) if cfg.blocked_tags else None
    return Masks(of, written(masks(store.tags, asked, blocked), "masks"))


def rrf(lists: DataFrame, k: int, *also: Column) -> DataFrame:
    """(query_id, doc_id, rank) rows of several lists -> summed 1/(k + rank), with further aggregates."""
    return lists.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"), *also)


class Search:
    """A table of queries on a store. Lists are planned when first asked for, so hits alone cost no totals."""

    def __init__(self, queries: DataFrame, store: SearchStore, query_vectors: DataFrame | None, embedder: Embedder | None, cfg: SearchConfig):
        self.store, self.cfg = store, cfg
        # The parsed query table feeds every list: its lineage is cut, so that lists plan against a scan.
        parsed = with_asks(prepare_queries(queries), store.text.cfg.token_pattern, cfg.blocked_tags)
        alone = F.col("query_id").isNotNull() & (F.count("*").over(Window.partitionBy("query_id")) == 1)
        self.pq = written(parsed.withColumn("alone", alone), "queries")
        if query_vectors is None and embedder is not None:
            loose = self.pq.where("use_vector").select("query_id", "loose")
            query_vectors = written(embed(loose, "loose", embedder), "query-vectors")
        self.query_vectors = query_vectors

    def _of(self, pq: DataFrame) -> Search:
        """The search of some of its queries."""
        some = object.__new__(Search)
        some.store, some.cfg, some.pq, some.query_vectors = self.store, self.cfg, pq, self.query_vectors
        return some

    @cached_property
    def _again(self) -> Search | None:
        """The search of the queries whose id another has too, if there are any: what shares an id is answered together, so their
        lists are made a row a query and range."""
        some = self.pq.where("NOT alone AND query_id IS NOT NULL")
        return None if some.isEmpty() else self._of(some)

    @cached_property
    def masks(self) -> Masks:
        return query_masks(self.pq, self.store, self.cfg)

    @cached_property
    def _match(self) -> DataFrame:
        """Queries whose only clause is loose text."""
        some = self.pq.where((F.col("loose") != "") & (F.size("phrases") == 0))
        return some.select("query_id", F.lit(0).alias("clause_id"), F.col("loose").alias("text"))

    @cached_property
    def _with_phrases(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The queries with phrases (query_id, n_phrases, more), their phrases and their loose text."""
        some = self.pq.where(F.size("phrases") > 0)
        loose = some.where(F.col("loose") != "").select("query_id", F.lit(0).alias("clause_id"), F.col("loose").alias("text"))
        queries = some.select("query_id", F.size("phrases").alias("n_phrases"), (F.col("loose") != "").alias("more"))
        return queries, some.select("query_id", F.posexplode("phrases").alias("clause_id", "text")), loose

    @cached_property
    def phrase_candidates(self) -> DataFrame:
        """(query_id, range, local, tscore): the documents that hold all phrases of a query with phrases, and a term of
        its loose text, if it has any. Loose text is only scored in ranges that hold all phrases."""
        queries, phrases, loose = self._with_phrases
        hits = inverted.phrase_hits(self.store.text, phrases, self.masks)
        both = hits.groupBy("query_id", "range", "local").agg(F.sum("score").alias("pscore"), F.count("*").alias("n"))
        both = both.join(queries, "query_id")
        both = written(both.where("n = n_phrases"), "phrase-candidates")
        ranges = both.where("more").select("query_id", F.lit(0).alias("clause_id"), "range").distinct()
        match = inverted.score_ranges(self.store.text, inverted.query_terms(self.store.text, loose), ranges).select("query_id", "range", "local", "score")
        joined = both.where("more").join(match, ["query_id", "range", "local"]).select("query_id", "range", "local", (F.col("pscore") + F.col("score")).alias("tscore"))
        return joined.unionByName(both.where("NOT more").select("query_id", "range", "local", F.col("pscore").alias("tscore")))

    def text_candidates(self) -> DataFrame:
        """(query_id, doc_id, tscore) of every document that matches all text clauses and the filters."""
        match = inverted.match_all_hits(self.store.text, self._match, self.masks).select("query_id", "range", "local", F.col("score").alias("tscore"))
        return self._named(match.unionByName(self.phrase_candidates)).select("query_id", "doc_id", "tscore")

    @cached_property
    def _lists_alone(self) -> DataFrame:
        """(query_id, mode, rank, range, local, doc_id, score, seq): the text list of each query with text, the first documents of
        the others, of queries whose id no other has."""
        return written(top_lists(self.store, self.pq.where("alone"), self.cfg.list_depth, self.cfg.limit), "lists")

    @cached_property
    def text_list(self) -> DataFrame:
        """(query_id, range, local, doc_id, tscore, trank): the best of the text list of each query."""
        found = self._lists_alone.where("mode IN ('hybrid', 'text')").select("query_id", "range", "local", "doc_id", F.col("score").alias("tscore"), F.col("rank").alias("trank"))
        return found if self._again is None else found.unionByName(self._again._text_list_of_all)

    @property
    def _text_list_of_all(self) -> DataFrame:
        depth = self.cfg.list_depth
        match = inverted.match_candidates(self.store.text, self._match, depth, self.masks).select("query_id", "range", "local", F.col("score").alias("tscore"))
        queries, phrases, loose = self._with_phrases
        best = inverted.conjunct_candidates(self.store.text, queries, phrases, loose, depth, self.masks)
        best = best.join(queries, ["query_id", "n_phrases", "more"]).select("query_id", "range", "local", F.col("score").alias("tscore"))
        named = top_k_per_group(self._named(match.unionByName(best)), "query_id", [round6("tscore").desc(), F.col("doc_id")], depth, "trank")
        return named.select("query_id", "range", "local", "doc_id", "tscore", "trank")

    @cached_property
    def vector_list(self) -> DataFrame | None:
        """I8: (query_id, range, local, doc_id, score, vrank) of queries with loose text."""
        if self.store.vectors is None or self.query_vectors is None:
            return None
        asked = self.pq.where("use_vector AND alone").select("query_id", "filter").join(self.query_vectors.select("query_id", "embedding"), "query_id")
        found = top_vectors(self.store, asked, self.cfg.list_depth)
        return found if self._again is None else found.unionByName(self._again._vector_list_of_all)

    @property
    def _vector_list_of_all(self) -> DataFrame:
        asked = self.pq.where("use_vector").select("query_id").join(self.query_vectors.select("query_id", "embedding"), "query_id")
        return nearest(self.store, asked, self.cfg.list_depth, self.masks)

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.store.text.docs.select("range", "local", "doc_id"), ["range", "local"])

    def _lists(self) -> DataFrame:
        """(query_id, doc_id, rank, tscore, vscore) of both lists."""
        none = F.lit(None).cast("double")
        lists = self.text_list.select("query_id", "doc_id", F.col("trank").alias("rank"), "tscore", none.alias("vscore"))
        if self.vector_list is not None:
            lists = lists.unionByName(self.vector_list.select("query_id", "doc_id", F.col("vrank").alias("rank"), none.alias("tscore"), F.col("score").alias("vscore")))
        return lists

    def fused(self) -> DataFrame:
        """(query_id, doc_id, fused, tscore, vscore)."""
        return rrf(self._lists(), self.cfg.rrf_k, F.max("tscore").alias("tscore"), F.max("vscore").alias("vscore"))

    def _plain(self) -> tuple[DataFrame, DataFrame]:
        """(query_id, filter) of the queries without text, and the masks of their filters."""
        of = self.pq.where("mode IN ('tags', 'all')").select("query_id").join(self.masks.of, "query_id")
        return of, self.masks.bits.join(of.select("filter").distinct(), "filter", "left_semi")

    def _first(self) -> DataFrame:
        """(query_id, doc_id, seq): the first documents of each query without text."""
        found = self._lists_alone.where("mode IN ('tags', 'all')").select("query_id", "doc_id", "seq")
        if self._again is None:
            return found
        # Queries without text share the list of their filter: it is made and cut once, then dealt to them.
        of, bits = self._again._plain()
        limit = self.cfg.limit
        listed = top_k_per_group(self._named(browse(self.store.orders, bits, limit)), "filter", [F.col("seq"), F.col("doc_id")], limit, "place")
        return found.unionByName(of.join(listed, "filter").select("query_id", "doc_id", "seq"))

    @cached_property
    def hits(self) -> DataFrame:
        """query_id, rank, doc_id, score, list_score, description, gif_url. Queries that say the same and have no vector of their own
        have the same rows, which are made once and dealt to them."""
        rows = self.pq
        if self.store.vectors is not None and self.query_vectors is not None:
            own = self.query_vectors.where("query_id IS NOT NULL").select("query_id", F.lit(True).alias("own")).distinct()
            rows = rows.join(own, "query_id", "left").withColumn("own", F.coalesce("own", F.lit(False)) & F.col("use_vector"))
        else:
            rows = rows.withColumn("own", F.lit(False))
        rows = rows.withColumn("deals", F.lit(1).cast("long"))
        kept = [c for c in rows.columns if c not in ("query_id", "ask", "mode", "deals")]
        same = rows.where("alone AND NOT own")
        # What very many say is dealt to them by several tasks.
        some = same.groupBy("ask", "mode").agg(F.min("query_id").alias("query_id"), *[F.first(c).alias(c) for c in kept], F.ceil(F.count("*") / QUERIES_A_DEAL).alias("deals"))
        some = written(some.select(*rows.columns).unionByName(rows.where("NOT alone OR own")), "different-queries")
        like = some.where("alone AND NOT own").select("ask", "mode", "deals", F.col("query_id").alias("like"))
        every = same.select("query_id", "ask", "mode").join(like, ["ask", "mode"]).select("query_id", "like", F.pmod(F.xxhash64("query_id"), "deals").alias("deal"))
        rest = some.where("query_id IS NOT NULL AND (NOT alone OR own)").select("query_id", F.col("query_id").alias("like"), F.lit(0).cast("long").alias("deal")).distinct()
        deals = some.select("query_id", "deals").distinct()
        found = self._of(some)._hits_of_each.join(deals, "query_id").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        return every.unionByName(rest).join(found.drop("deals").withColumnRenamed("query_id", "like"), ["like", "deal"]).drop("like", "deal")

    @property
    def _hits_of_each(self) -> DataFrame:
        limit, none = self.cfg.limit, F.lit(None).cast("double")
        ranked = self.fused().join(self.pq.select("query_id", "mode"), "query_id")
        hybrid = F.col("mode") == "hybrid"
        ranked = ranked.select("query_id", "doc_id", F.when(hybrid, F.col("fused")).otherwise(F.col("tscore")).alias("list_score"),
                               F.when(hybrid, F.col("vscore")).alias("vec_score"), F.lit(0).cast("long").alias("tie_seq"))
        plain = self._first().select("query_id", "doc_id", F.lit(1.0).alias("list_score"), none.alias("vec_score"), F.col("seq").alias("tie_seq"))
        order = [round6("list_score").desc(), F.col("tie_seq"), F.col("doc_id")]
        # G1: the limit comes before moderation; only these rows meet the display fields.
        top = written(top_k_per_group(ranked.unionByName(plain), "query_id", order, limit, "pre_rank"), "top")
        joined = self.store.rows.join(bounded_broadcast(top, 200_000), "doc_id")
        kept = joined.where(~is_removed("literal", "description", "combined_text") & ~has_blocked_tag("tags", self.cfg.blocked_tags))
        return top_k_per_group(kept, "query_id", [F.col("pre_rank")], limit, "rank").select(
            "query_id", "rank", "doc_id",
            display_score("vec_score", "list_score").alias("score"),
            F.col("list_score"),
            display_description().alias("description"),
            F.coalesce("gif_url", F.lit("")).alias("gif_url"))

    @cached_property
    def totals(self) -> DataFrame:
        """(query_id, total) before the limit; hybrid: the distinct documents of both lists' candidates."""
        key = ["query_id", "range", "local"]
        vector = self.vector_list.select(*key) if self.vector_list is not None else self.phrase_candidates.select(*key).limit(0)
        vector = written(vector, "vector-places")
        loose = inverted.count_matches(self.store.text, self._match, self.masks, vector)
        loose = loose.unionByName(vector.join(self._match.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n")))
        some = self.pq.where(F.size("phrases") > 0).select("query_id")
        phrases = self.phrase_candidates.select(*key).unionByName(vector.join(some, "query_id", "left_semi")).distinct().groupBy("query_id").agg(F.count("*").alias("n"))
        of, bits = self._plain()
        plain = of.join(bits.groupBy("filter").agg(F.sum(F.bitmap_count("mask")).alias("n")), "filter").select("query_id", "n")
        n = loose.unionByName(phrases).unionByName(plain).groupBy("query_id").agg(F.sum("n").alias("total"))
        return self.pq.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def search(queries: DataFrame, docs: DataFrame | SearchStore, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
           cfg: SearchConfig = SearchConfig(), embedder: Embedder | None = None) -> Search:
    """I13. queries: (query_id, raw); docs: a written store, or store rows (doc_id, seq, combined_text, tags, literal,
    description?, original_description, gif_url), for which one is written first; vectors: (doc_id, embedding);
    query_vectors: (query_id, embedding) for the semantic list. Vectors that aren't given are made by the embedder, if
    there is one, from the store's text and the query's loose text."""
    if not isinstance(docs, SearchStore):
        docs = write_store(docs, scratch(queries.sparkSession, "search-store"), vectors, embedder, cfg=cfg)
    return Search(queries, docs, query_vectors, embedder, cfg)


def lookup_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookup of an id table; removed documents vanish, blocked tags are not checked, score 0."""
    docs = ensure_cols(docs, ("literal", "description", "original_description", "combined_text", "gif_url"))
    return (docs.join(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .where(~is_removed("literal", "description", "combined_text"))
            .select("doc_id", F.lit(0.0).alias("score"), F.coalesce("gif_url", F.lit("")).alias("gif_url"),
                    display_description().alias("description")))
