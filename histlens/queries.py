"""Registered queries over the histories projected from the ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dsl
from .model import Histories, Level, session_of
from .operators import graph, reach, relations, validate
from .operators.written import written
from .plans import check as checks
from .plans import saturation, witness
from .sources import event_table, generate, json_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def observed(spark: SparkSession, sf_dir: str) -> Histories:
    """As recorded, with aborted transactions."""
    return event_table.read(spark, sf_dir)


def stale(spark: SparkSession, sf_dir: str) -> Histories:
    """Structurally sound, with stale reads: for the levels."""
    return event_table.read(spark, sf_dir, stale=True, all_committed=True)


def lossy(spark: SparkSession, sf_dir: str) -> Histories:
    """As recorded, with every 13th write lost and versions reused."""
    hs = observed(spark, sf_dir)
    kept = hs.events.where("op = 'R' OR (version - 1) % 13 <> 0").withColumn("version", F.col("version") % 997)
    return Histories(kept, hs.txns, hs.hist)


def reused(spark: SparkSession, sf_dir: str) -> Histories:
    """As recorded, with versions modulo 7: writes repeat."""
    hs = observed(spark, sf_dir)
    return Histories(hs.events.withColumn("version", F.col("version") % 7), hs.txns, hs.hist)


def turned(spark: SparkSession, sf_dir: str) -> Histories:
    """As recorded, with each transaction's two events exchanged: reads of own writes come too early."""
    hs = observed(spark, sf_dir)
    return Histories(hs.events.withColumn("pos", 1 - F.col("pos")), hs.txns, hs.hist)


@query
def scan_events(spark, sf_dir):
    return observed(spark, sf_dir).events


@query
def scan_transactions(spark, sf_dir):
    return observed(spark, sf_dir).txns


@query
def resolve_reads(spark, sf_dir):
    return validate.resolve_reads(observed(spark, sf_dir))


@query
def same_version_writes(spark, sf_dir):
    return validate.same_version_writes(reused(spark, sf_dir))


@query
def final_writes(spark, sf_dir):
    return validate.final_writes(observed(spark, sf_dir))


@query
def incomplete_reads(spark, sf_dir):
    return validate.incomplete_reads(validate.resolve_reads(lossy(spark, sf_dir)))


@query
def inconsistent_local_reads(spark, sf_dir):
    hs = turned(spark, sf_dir)
    return validate.inconsistent_local_reads(hs, validate.resolve_reads(hs))


@query
def dirty_reads(spark, sf_dir):
    hs = observed(spark, sf_dir)
    return validate.dirty_reads(hs, validate.resolve_reads(hs))


@query
def overwritten_reads(spark, sf_dir):
    hs = stale(spark, sf_dir)
    return validate.overwritten_reads(hs, validate.resolve_reads(hs))


@query
def non_repeatable_reads(spark, sf_dir):
    hs = stale(spark, sf_dir)
    return validate.non_repeatable_reads(hs, validate.resolve_reads(hs))


@query
def first_error(spark, sf_dir):
    return validate.first_error(lossy(spark, sf_dir))


@query
def session_order(spark, sf_dir):
    return relations.session_order(observed(spark, sf_dir))


@query
def wr_edges(spark, sf_dir):
    return relations.write_read(validate.resolve_reads(observed(spark, sf_dir)))


@query
def wr_union(spark, sf_dir):
    return relations.write_read_union(validate.resolve_reads(observed(spark, sf_dir)))


def _with_reads(hs: Histories) -> tuple[Histories, DataFrame]:
    """Events read once, and the reads from writes."""
    hs = Histories(written(hs.events, "events"), hs.txns, hs.hist)
    return hs, written(relations.write_read(validate.resolve_reads(hs)), "wr")


@query
def ww_edges(spark, sf_dir):
    return relations.plain_write_write(*_with_reads(stale(spark, sf_dir)))


@query
def rw_edges(spark, sf_dir):
    return relations.plain_read_write(*_with_reads(stale(spark, sf_dir)))


@query
def rc_order_edges(spark, sf_dir):
    hs = stale(spark, sf_dir)
    return relations.committed_order(hs, validate.resolve_reads(hs))


@query
def vis_closure(spark, sf_dir):
    hs = stale(spark, sf_dir)
    wr = relations.write_read(validate.resolve_reads(hs))
    return reach.pairs_of(hs, reach.composed(reach.chain(hs).unionByName(reach.edges_of(wr))))


@query
def edge_closure(spark, sf_dir):
    """Paths over any edge table, without the order of sessions: here of reads from writes."""
    hs = stale(spark, sf_dir)
    return graph.closure(relations.write_read_union(validate.resolve_reads(hs)))


def _atomic(spark, sf_dir) -> tuple[Histories, DataFrame, DataFrame]:
    """Visibility with one round of write-write order: has cycles where reads are stale."""
    hs, wr = _with_reads(stale(spark, sf_dir))
    return hs, wr, reach.cycles(reach.atomic_rows(hs, wr))


@query
def cycle_vertices(spark, sf_dir):
    return _atomic(spark, sf_dir)[2].select("h", "v")


@query
def cycle_edge(spark, sf_dir):
    return reach.first_edge(*_atomic(spark, sf_dir))


@query
def topo_levels(spark, sf_dir):
    hs = observed(spark, sf_dir)
    return graph.topo_levels(relations.visibility_base(hs, validate.resolve_reads(hs), closed=False))


def _sessions(hs: Histories) -> tuple[DataFrame, DataFrame]:
    accesses = hs.events.select("h", "variable", session_of("txn").alias("s"))
    return graph.communication_graph(accesses), hs.txns.select("h", session_of("txn").alias("v")).distinct()


@query
def comm_graph(spark, sf_dir):
    return _sessions(observed(spark, sf_dir))[0]


@query
def connected_components(spark, sf_dir):
    return graph.connected_components(*_sessions(observed(spark, sf_dir)))


@query
def biconnected_components(spark, sf_dir):
    found = graph.biconnected_components(*_sessions(observed(spark, sf_dir)))
    return found.select("h", F.array_join(F.col("block").cast("array<string>"), ",").alias("block"))


@query
def block_overlap(spark, sf_dir):
    return graph.blocks_overlap(graph.biconnected_components(*_sessions(observed(spark, sf_dir))))


def _plan(level: Level) -> Query:
    def run(spark, sf_dir):
        return saturation.check(stale(spark, sf_dir), level)

    return run


def _kernel(level: Level, engine: str = "search") -> Query:
    def run(spark, sf_dir):
        return checks.check(stale(spark, sf_dir), level, witness=False, engine=engine).select("h", "ok", "error_kind", "error_level", "error_code")

    return run


LEVELS = dict(zip(("rc", "rr", "ra", "causal", "prefix", "si", "ser"), Level, strict=True))
for _name, _level in LEVELS.items():
    QUERIES[f"check_{_name}"] = _kernel(_level)
    if _level in saturation.PLANS:
        QUERIES[f"check_{_name}_by_joins"] = _plan(_level)
    if _level.rank > Level.CAUSAL.rank:
        QUERIES[f"check_{_name}_by_ordering"] = _kernel(_level, "ordering")


@query
def level_summary(spark, sf_dir):
    return checks.level_summary(stale(spark, sf_dir))


@query
def check_observed(spark, sf_dir):
    """Every level over the histories as recorded; most fail structurally."""
    return checks.level_summary(observed(spark, sf_dir))


@query
def causal_steps(spark, sf_dir):
    return checks.causal_steps(stale(spark, sf_dir))


@query
def invalid_witnesses(spark, sf_dir):
    """Witnesses of the three strongest levels checked by joins; empty unless the search is wrong."""
    hs = stale(spark, sf_dir)
    out = None
    for level in (Level.SERIALIZABLE, Level.SNAPSHOT_ISOLATION, Level.PREFIX):
        # a single session's order is by definition and needs no check against stale initial reads
        several = hs.where_histories(hs.hist.where("n_sessions > 1"))
        order = written(witness.order_rows(checks.check(several, level), level), "order")
        bad = witness.invalid_orders(several, order, level).withColumn("level", F.lit(str(level)))
        out = bad if out is None else out.union(bad)
    return out


@query
def invalid_orders(spark, sf_dir):
    """What an order by height, then session breaks as a serial one: most histories' reads."""
    from pyspark.sql import Window

    hs = stale(spark, sf_dir)
    height = F.col("txn").bitwiseAND(F.lit((1 << 32) - 1))
    order = hs.txns.select("h", (F.row_number().over(Window.partitionBy("h").orderBy(height, "txn")) - 1).alias("i"), "txn", F.lit(True).alias("is_write"))
    return witness.invalid_orders(hs, order, Level.SERIALIZABLE)


@query
def witness_pairs(spark, sf_dir):
    """Neighbours in the order of session, then height: a fixed order for every history."""
    from pyspark.sql import Window

    order = observed(spark, sf_dir).txns.select("h", "txn", (F.row_number().over(Window.partitionBy("h").orderBy("txn")) - 1).cast("long").alias("i"))
    return witness.consecutive(order)


@query
def format_txn(spark, sf_dir):
    return dsl.format_transactions(observed(spark, sf_dir))


@query
def format_txn_debug(spark, sf_dir):
    return dsl.format_transactions(observed(spark, sf_dir), debug=True)


@query
def format_history(spark, sf_dir):
    return dsl.format_histories(observed(spark, sf_dir))


@query
def dictionary_encode(spark, sf_dir):
    return dsl.dictionary(observed(spark, sf_dir))


@query
def tokenize_dsl(spark, sf_dir):
    return dsl.token_table(dsl.format_histories(observed(spark, sf_dir)))


@query
def parse_dsl(spark, sf_dir):
    """Formatted, parsed again: equal to scan_events() with positions renumbered within transactions."""
    return dsl.read_histories(dsl.format_histories(observed(spark, sf_dir))).events


@query
def json_round_trip(spark, sf_dir):
    decoded = json_files.decode(json_files.encode(observed(spark, sf_dir)))
    from .model import from_nested

    return from_nested(decoded.where("message IS NULL")).events


@query
def json_compact_round_trip(spark, sf_dir):
    decoded = json_files.decode(json_files.encode(observed(spark, sf_dir), compact=True))
    from .model import from_nested

    return from_nested(decoded.where("message IS NULL")).events


@query
def generated_levels(spark, sf_dir):
    """Levels of 200 generated histories (seeded)."""
    return checks.level_summary(generate.histories(generate.generate(spark, 200, 3, 4, 3, 3, seed=7)))


@query
def workload_levels(spark, sf_dir):
    """Levels of the regular workload, 8 sessions of 10 transactions of 5 events."""
    return checks.level_summary(generate.workload(spark, 50, 8, 10, 5))
