"""The stage machine: discovery, collection, processing, generation, quality, export over stage tables.

Every stage is a DataFrame transform; its output is written by session partition, so that a later start reads
it back and a repeated run replaces it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import markup, text
from ..functions.urls import matches, sanitise
from ..operators import chunks, generate, quality
from ..operators.relational import exclude_known, keep_first
from ..schemas import STAGES
from ..sinks import local
from ..sources.discovery import sitemap_closure

ORDER = STAGES[:-1]
VIEW_ORDER = {"discovery": "ord", "collection": "page_id", "processing": "chunk_id", "generation": "id", "quality": "id"}


def discover(urls: DataFrame, cfg: CurationConfig, known: DataFrame | None = None) -> DataFrame:
    """(ord, url, source, selected) of (ord, url, source): first mention wins, known URLs left out on request."""
    if cfg.sanitise_discovered:
        urls = urls.withColumn("url", sanitise(F.col("url"))).where("url IS NOT NULL")
    out = keep_first(urls, ["url"], ["ord"])
    if cfg.skip_known and known is not None:
        out = exclude_known(out, known, ["url"])
    out = out.withColumn("selected", F.lit(True))
    return out.orderBy("ord").limit(cfg.max_pages) if cfg.max_pages else out


def collect(selected: DataFrame, fetched: DataFrame) -> DataFrame:
    """Pages of the selected URLs (page_id, url, ...) from fetched bodies (url, html, page_id); blank texts go."""
    pages = fetched.join(selected.select("url").distinct(), "url", "left_semi")
    out = pages.withColumn("x", markup.extract(F.col("html"), F.col("url"))).select("page_id", "url", "x.*")
    return out.where(F.col("text").rlike(r"(?U)\S")).withColumnsRenamed({"published_date": "date"})


def process(pages: DataFrame, cfg: CurationConfig) -> DataFrame:
    cleaned = pages.withColumn("content", text.clean(F.coalesce("markdown", F.lit("")))).where(text.is_content_rich(F.col("content"), cfg.min_page_words))
    packed = chunks.chunks_fast(F.col("content"), cfg.chunk_size, cfg.chunk_overlap, vocabulary=cfg.vocabulary)
    return chunks.records(cleaned, packed, cfg.session_id, cfg.vocabulary)


def make(records: DataFrame, cfg: CurationConfig, generator=generate.echo_generator) -> DataFrame:
    return generate.generate(records, cfg.format, cfg.goal, cfg.n_per_chunk, cfg.custom_system, generator)


def judge(samples: DataFrame, cfg: CurationConfig) -> DataFrame:
    out = quality.quality_pass(samples, cfg.quality_threshold, cfg.min_question_words, cfg.min_answer_words)
    return out.withColumnRenamed("score", "quality_score")


@dataclass(frozen=True)
class Inputs:
    """What a run is given: (ord, url, source), fetched bodies (url, html, page_id) and, where they are skipped, known URLs (url)."""

    urls: DataFrame
    fetched: DataFrame
    known: DataFrame | None = None


class Stage(Protocol):
    """A stage: the pipeline, whose ``read`` gives the tables of earlier stages, and the inputs of the run in; its own table out."""

    def __call__(self, pipeline: Pipeline, given: Inputs) -> DataFrame: ...


#: The stages that fill a table, by name; a Pipeline may be given others in their place.
DEFAULT: dict[str, Stage] = {
    "discovery": lambda p, given: discover(given.urls, p.cfg, given.known),
    "collection": lambda p, given: collect(p.read("discovery").where("selected"), given.fetched),
    "processing": lambda p, given: process(p.read("collection"), p.cfg),
    "generation": lambda p, given: make(p.read("processing"), p.cfg, p.generator),
    "quality": lambda p, given: judge(p.read("generation"), p.cfg),
}


@dataclass
class Pipeline:
    """Runs stages from start to stop over tables below ``root``. Hooks see each stage; a post hook returning False pauses.

    ``stages`` replaces stages by name. ``progress`` is told (stage, what was written, rows) as each table or export ends,
    counted while it was written.
    """

    spark: SparkSession
    root: str
    cfg: CurationConfig = field(default_factory=CurationConfig)
    generator: generate.Generator | None = generate.echo_generator
    pre_stage: Callable[[str], None] | None = None
    post_stage: Callable[[str, DataFrame], bool] | None = None
    stages: dict[str, Stage] = field(default_factory=dict)
    progress: Callable[[str, str, int], None] | None = None

    def __post_init__(self) -> None:
        if unknown := set(self.stages) - set(DEFAULT):
            raise ValueError(f"no stages of these names: {sorted(unknown)}")

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{stage}").where(F.col("session_id") == self.cfg.session_id).drop("session_id")

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        rows = local.replace_session(df.withColumn("session_id", F.lit(self.cfg.session_id)), self.root, stage)
        self._tell(stage, "table", rows)
        return self.read(stage)

    def _tell(self, stage: str, what: str, rows: int) -> None:
        if self.progress:
            self.progress(stage, what, rows)

    def _export(self) -> DataFrame:
        rows = local.export_rows(self.read("quality").withColumn("session_id", F.lit(self.cfg.session_id)))
        root, written = f"{self.root}/export/{self.cfg.session_id}", {}

        def tell(kind: str, n: int) -> None:
            written[kind] = n
            self._tell("export", kind, n)

        for kind, path in local.export_all(rows, root, progress=tell).items():
            local.append_table(local.export_log(written[kind], self.spark, self.cfg.session_id, "local", path, kind, "export"), self.root, "export_log")
        return rows

    def run(self, urls: DataFrame, fetched: DataFrame, start: str = ORDER[0], stop: str = ORDER[-1], known: DataFrame | None = None) -> str:
        """The status: completed, or paused by a hook. Without a generator, generation is skipped; without samples, quality is."""
        given, steps = Inputs(urls, fetched, known), DEFAULT | self.stages
        for stage in ORDER[ORDER.index(start) : ORDER.index(stop) + 1]:
            if stage == "generation" and self.generator is None:
                continue
            if stage in ("quality", "export") and self.generator is None and not self._has("generation"):
                continue
            if self.pre_stage:
                self.pre_stage(stage)
            out = self._export() if stage == "export" else self.save(stage, steps[stage](self, given))
            if self.post_stage and self.post_stage(stage, out) is False:
                return "paused"
        return "completed"

    def resume(self, urls: DataFrame, fetched: DataFrame, **how) -> str:
        """Go on at the first stage without a table."""
        start = next((s for s in ORDER[:-1] if not self._has(s)), ORDER[-1])
        return self.run(urls, fetched, start=start, **how)

    def view(self, stage: str, limit: int = 5) -> tuple[DataFrame, int]:
        """The first rows of a stage and how many more there are."""
        df = self.read(stage)
        order = VIEW_ORDER[stage]
        return df.orderBy(order).limit(limit), max(0, df.count() - limit)

    def _has(self, stage: str) -> bool:
        """Whether the stage has rows; only a missing or empty folder means that it has none, any other failure is one."""
        try:
            return not self.read(stage).isEmpty()
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise

    def counts(self) -> dict[str, int]:
        return {stage: self.read(stage).count() for stage in ORDER[:-1] if self._has(stage)}


def sessions(df: DataFrame, status: list[str] | None = None) -> DataFrame:
    """Sessions by creation, newest first."""
    out = df.where(F.col("status").isin(status)) if status else df
    return out.orderBy(F.desc("created_at"), "id")


def latest(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The session last touched, per group when given."""
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc(F.coalesce("updated_at", "created_at")), "id")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def explore(fetched: DataFrame, seed: str, pattern: str | None = None) -> DataFrame:
    """(ord, url) of a sitemap without keeping anything; fetched: (url, status, body)."""
    return sitemap_closure(fetched, seed).where(matches(F.col("url"), pattern))


def status(df: DataFrame) -> DataFrame:
    """(status, n) of the sessions, with the share of paused ones."""
    n = df.groupBy("status").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "paused").alias("paused"))
    return n.crossJoin(F.broadcast(total))


def stage_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(stage, n) of the stage tables in one pass."""
    out = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("stage"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("stage").agg(F.count("*").alias("n"))
