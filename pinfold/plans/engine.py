"""The API: one object over the loaded tables, a method per kind of question. Results are DataFrames."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from pinfold.functions import names as N, text as T
from pinfold.operators import facts as X, search as S, symbols as Y
from pinfold.plans import code as C
from pinfold.plans.router import route

WEIGHTS = S.WEIGHTS
KEY = ["doc_id", "ord"]


@dataclass
class Engine:
    """Tables: chunk, symbol and vendordep, each row once."""

    spark: SparkSession
    chunk: DataFrame
    symbol: DataFrame
    vendordep: DataFrame
    _index: S.Index | None = None

    def index(self) -> S.Index:
        """The stored index of the chunks, written at the first search."""
        if self._index is None:
            docs = self.chunk.withColumn("expand", T.expand(F.col("symbol"), F.col("title"), F.col("body")))
            self._index = S.build_index(docs, KEY, WEIGHTS, ["season"])
        return self._index

    def default_season(self) -> str:
        return X.default_season(self.chunk).first()[0] or ""

    def _ranked(self, query: str, d: Row, season: str | None, language: str, libraries: list[str], kinds: list[str]) -> DataFrame:
        q = self.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        terms = q.withColumn("terms", S.terms_of(F.col("query")))
        scored = self.index().bm25(terms)
        ok = F.lit(True)
        if season:
            ok = ok & (F.col("season") == season)
        if language and language != "any":
            ok = ok & F.lower(F.trim("language")).isin(language, "any")
        if "forum" not in kinds and d.intent != "troubleshoot":
            ok = ok & (F.col("trust") != "community")
        if libraries:
            ok = ok & F.col("library").isin(libraries)
        if kinds:
            ok = ok & F.lower(F.trim("kind")).isin(kinds)
        visible = self.chunk.filter(ok).select(*KEY, "season", "library", "kind", "trust", "channel", F.coalesce("suspect", F.lit(False)).alias("suspect"))
        order = [F.col("score").desc(), F.col("doc_id"), F.col("ord")]
        lex = S.top(scored.join(visible, KEY).select("query_id", *KEY, "score"), order, S.DEPTH).select("query_id", *KEY, "rank")
        lists = [lex]
        named = None
        if d.identifiers:
            ids = self.spark.createDataFrame([(str(i), n) for i, n in enumerate(d.identifiers[:4])], "query_id string, name string")
            known = self.symbol.filter(F.col("season") == season) if season else self.symbol
            found = Y.lookup(ids, known)
            at = N.parse_chunk_id(F.trim("chunk_id"))
            at_chunk = found.select("fqn").distinct().join(known.select("fqn", at["doc_id"].alias("doc_id"), at["ord"].alias("ord")), "fqn").filter("ord IS NOT NULL").select(*KEY).distinct()
            named = at_chunk.join(visible, KEY, "left_semi").withColumn("query_id", F.lit(0).cast("bigint"))
            lists.append(S.top(named, [F.col("doc_id"), F.col("ord")], S.DEPTH).select("query_id", *KEY, "rank"))
        fused = S.rrf(*lists, key=KEY)
        hit = F.lit(False)
        if named is not None:
            fused = fused.join(named.select(*KEY).withColumn("__h", F.lit(True)), KEY, "left")
            hit = F.coalesce("__h", F.lit(False))
        rows = fused.join(visible, KEY).withColumn("symbol_hit", hit)
        factor = S.boost({
            "symbol_hit": F.col("symbol_hit"), "named": F.lit(bool(d.libraries)), "library_hit": F.col("library").isin(d.libraries) if d.libraries else F.lit(False), "trust": F.col("trust"),
            "kind": F.lower(F.trim("kind")), "intent": F.lit(d.intent), "suspect": F.col("suspect"), "alpha_penalty": (F.col("channel") == "alpha") & F.lit(not d.asked_season),
        })
        return S.diversify(rows.withColumn("score", F.col("score") * factor), ["doc_id"], order)

    def search(self, query: str, season: str = "", language: str = "", libraries: list[str] | None = None, kinds: list[str] | None = None, k: int = 5) -> tuple[str, DataFrame]:
        """(status, hits). The season is the argument's, else the query's, else the default; hits are of that season only,
        unless the status is version_mismatch, which has up to five of others beside up to three of that season."""
        if not query.strip() or not 1 <= k <= S.DEPTH:
            raise ValueError("a query is needed, and 1 to 50 hits")
        d = route(self.spark.createDataFrame([(query,)], "query string")).first()
        pin = season or d.asked_season or self.default_season()
        lang = language or d.asked_language
        own = self._ranked(query, d, pin, lang, libraries or [], kinds or [])
        sure = self._confidence(query, own)
        if sure is not None and sure >= S.LOW:
            return "ok", self._hydrate(own, k)
        other = self._ranked(query, d, None, lang, libraries or [], kinds or []).filter(F.col("season") != pin)
        elsewhere = self._confidence(query, other)
        if elsewhere is not None and (sure is None or elsewhere >= S.STRONG):
            return "version_mismatch", self._hydrate(own, min(k, S.ABSTAIN)).unionByName(self._hydrate(other, S.OTHERS))
        return ("no_match", own.limit(0)) if sure is None else ("low_confidence", self._hydrate(own, min(k, S.ABSTAIN)))

    def _confidence(self, query: str, ranked: DataFrame) -> float | None:
        from pinfold.functions.text import content_terms

        two = ranked.orderBy("rank").limit(2).join(self.chunk.select(*KEY, "title", "heading_path", "symbol", "body"), KEY)
        cover = S.coverage(content_terms(F.lit(query)), *[F.col(c) for c in ("title", "heading_path", "symbol", "body")])
        rows = two.select("score", "lists", "symbol_hit", cover.alias("cover")).orderBy(F.col("score").desc()).collect()
        if not rows:
            return None
        first, gap = rows[0], (rows[0].score - rows[1].score) / rows[0].score if len(rows) > 1 else 0.0
        lit = self.spark.range(1).select(S.confidence(F.lit(first.score), F.lit(first.lists), F.lit(first.cover), F.lit(gap), F.lit(first.symbol_hit)).alias("c"))
        return lit.first()[0]

    def _hydrate(self, ranked: DataFrame, k: int) -> DataFrame:
        """Bodies of the page's rows only; a page has at most 50."""
        page = ranked.orderBy("rank").limit(k).select(*KEY, "score", "rank")
        return self.chunk.join(F.broadcast(page), KEY)

    def fetch(self, id: str) -> DataFrame:
        at = self.spark.createDataFrame([(id.rsplit("/chunk/", 1)[-1],)], "id string").select(N.parse_chunk_id(F.col("id")).alias("a")).select("a.*").filter("ord IS NOT NULL")
        return self.chunk.join(F.broadcast(at), KEY)

    def api(self, name: str, season: str = "") -> DataFrame:
        rows = self.symbol.filter(F.col("season") == season) if season else self.symbol
        return Y.lookup(self.spark.createDataFrame([("0", name)], "query_id string, name string"), rows)

    def catalog(self, name: str) -> DataFrame:
        return X.resolve(self.spark.createDataFrame([(name,)], "query string"), self.vendordep)

    def check(self, installed: DataFrame, season: str) -> tuple[DataFrame, DataFrame]:
        return X.check(installed, self.vendordep, season), X.conflicts(installed, self.vendordep)

    def verify(self, files: DataFrame, roots: list[str], season: str) -> DataFrame:
        return C.verify(C.references(files, "path", "code", "language", roots), self.symbol, season)

    def migrate(self, files: DataFrame, roots: list[str], rules: DataFrame, start: str, target: str) -> DataFrame:
        return C.migrate(C.references(files, "path", "code", "language", roots), self.symbol, rules, start, target)

    def manifest(self) -> DataFrame:
        return self.chunk.groupBy("library", "season").agg(F.count("*").alias("chunks"), F.max("retrieved_at").alias("built"))


def encode_pin(pin: dict) -> str:
    return "pin1." + base64.urlsafe_b64encode(json.dumps(pin, sort_keys=True).encode()).decode().rstrip("=")


def decode_pin(text: str) -> dict:
    if not text.startswith("pin1."):
        raise ValueError("not a pin")
    body = text[5:]
    return json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))


def encode_cursor(query_key: str, digest: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "q": query_key, "d": digest, "o": offset}).encode()).decode()


def decode_cursor(text: str, query_key: str, digest: str) -> int:
    """The offset; a cursor of another query or of other data is refused."""
    c = json.loads(base64.urlsafe_b64decode(text))
    if c.get("v") != 1 or c.get("q") != query_key or c.get("d") != digest:
        raise ValueError("the cursor belongs to another query or to other data")
    return int(c["o"])
