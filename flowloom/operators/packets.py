"""Bidirectional flows and their 67 features from packet tables.

A packet table has the columns of ``schemas.PACKET`` plus ``seq``, the arrival
number that breaks timestamp ties. The two sides of a flow are first told apart
by endpoint order (``lo`` and ``hi``); which side is forward is only decided in
the final projection from the first packet, so no packet-level join is needed.

Whatever depends on packet order is one ordered pass: within a slice of a flow gaps and
bursts come from window steps over one exchange and one sort, a slice leaves one summary
(first and last times, moments of gaps and closed bursts, the burst still open at either end), and
summaries are composed along the slices of a flow. Only hot flows have more than one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.parsing import micros
from flowloom.operators.ordered import Slices, with_slices
from flowloom.schemas import APPROXIMATED_FEATURES, FLOW_FEATURES

FLOW_KEY = ("protocol", "lo_ip", "lo_port", "hi_ip", "hi_port")
RATE_FLOOR_SECONDS = 1e-6


def usable_packet() -> Column:
    """Source, destination, protocol and timestamp are all present."""
    return (
        F.coalesce(F.col("src_ip") != "", F.lit(False))
        & F.coalesce(F.col("dst_ip") != "", F.lit(False))
        & F.col("protocol").isNotNull()
        & F.col("ts").isNotNull()
    )


def drop_malformed(packets: DataFrame) -> DataFrame:
    return packets.filter(usable_packet())


def packet_quality(packets: DataFrame) -> DataFrame:
    return packets.agg(
        F.count("*").alias("records"),
        F.count_if(usable_packet()).alias("accepted"),
        F.count_if(~usable_packet()).alias("rejected"),
    )


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add the direction-free key columns and ``from_lo``."""
    a = F.struct(F.col("src_ip").alias("ip"), F.coalesce("src_port", F.lit(-1)).alias("port"))
    b = F.struct(F.col("dst_ip").alias("ip"), F.coalesce("dst_port", F.lit(-1)).alias("port"))
    keyed = packets.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b), "from_lo": a == F.least(a, b)})
    return keyed.withColumns(
        {
            "lo_ip": F.col("_lo.ip"),
            "lo_port": F.col("_lo.port"),
            "hi_ip": F.col("_hi.ip"),
            "hi_port": F.col("_hi.port"),
        }
    ).drop("_lo", "_hi")


def with_direction(packets: DataFrame) -> DataFrame:
    """Add ``is_forward``: the packet leaves from the endpoint that spoke first."""
    keyed = packets if "from_lo" in packets.columns else with_flow_key(packets)
    first = keyed.groupBy(*FLOW_KEY).agg(F.min_by("from_lo", F.struct("ts", "seq")).alias("_first"))
    return keyed.join(first, list(FLOW_KEY)).withColumn("is_forward", F.col("from_lo") == F.col("_first")).drop("_first")


def reconstruct_flows(packets: DataFrame, keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """One row per flow without timeouts: endpoints, first/last time, counters."""
    keyed = packets if "from_lo" in packets.columns else with_flow_key(packets)
    first = F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "from_lo"), F.struct("ts", "seq"))
    size = F.coalesce(F.col("total_length"), F.lit(0)).cast("long")
    totals = keyed.groupBy(*keys).agg(
        first.alias("f"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("total_packets"),
        F.count_if("from_lo").alias("n_lo"),
        F.sum(size).alias("total_bytes"),
        F.sum(F.when(F.col("from_lo"), size).otherwise(0)).alias("b_lo"),
    )
    ahead = F.col("f.from_lo")
    return totals.select(
        *[k for k in keys if k not in FLOW_KEY or k == "protocol"],
        *[F.col(f"f.{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")],
        "start_ts",
        "end_ts",
        "total_packets",
        F.when(ahead, F.col("n_lo")).otherwise(F.col("total_packets") - F.col("n_lo")).alias("forward_packets"),
        F.when(ahead, F.col("total_packets") - F.col("n_lo")).otherwise(F.col("n_lo")).alias("backward_packets"),
        "total_bytes",
        F.when(ahead, F.col("b_lo")).otherwise(F.col("total_bytes") - F.col("b_lo")).alias("forward_bytes"),
        F.when(ahead, F.col("total_bytes") - F.col("b_lo")).otherwise(F.col("b_lo")).alias("backward_bytes"),
    )


ORDER = ("_t", "seq")
#: Measures whose mean and spread are wanted, and the single values that slice borders add to each.
GAP_MOMENTS = {"gap": ["_b_gap"], "gap_lo": ["_b_lo"], "gap_hi": ["_b_hi"]}
BURST_MOMENTS = {"closed_burst": ["_b_burst", "_h_burst"], "idle_gap": ["_b_idle"]}
MOMENTS = {"len": [], "len_lo": [], "len_hi": []} | GAP_MOMENTS | BURST_MOMENTS
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece")
COUNTS = (*(f"flag_{f}" for f in FLAGS), *(f"{c}_{s}" for s in ("lo", "hi") for c in ("psh", "urg", "data")))


def _within_slices(packets: DataFrame, keys: Sequence[str], idle_seconds: float, slices: Slices | None) -> tuple[DataFrame, list[str]]:
    """Packets with what they see of earlier ones in their slice, and the columns that make a slice.

    ``gap``, ``gap_lo`` and ``gap_hi`` are microseconds since the previous packet and
    since the previous one of the same side. A gap of at least ``idle_seconds`` ends a burst:
    ``burst_start`` is set there, ``closed_burst`` is the length of the burst before it if that
    began in the slice, and ``_head`` the end of one that did not.
    """
    keyed = packets if "from_lo" in packets.columns else with_flow_key(packets)
    t = keyed.withColumn("_t", micros("ts"))
    part = list(keys)
    if slices is not None:
        t, part = with_slices(t, keys, ORDER, slices), [*keys, "_slice"]
    t = t.withColumns({"_t_lo": F.when(F.col("from_lo"), F.col("_t")), "_t_hi": F.when(~F.col("from_lo"), F.col("_t"))})
    ahead = Window.partitionBy(*part).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    seen = t.withColumns({f"_p{s}": F.max(f"_t{s}").over(ahead) for s in ("", "_lo", "_hi")})
    seen = seen.withColumns({f"gap{s}": F.col(f"_t{s}") - F.col(f"_p{s}") for s in ("", "_lo", "_hi")})
    idle = F.col("gap") >= F.lit(int(idle_seconds * 1_000_000))
    seen = seen.withColumns({"burst_start": F.when(idle, F.col("_t")), "idle_gap": F.when(idle, F.col("gap"))})
    seen = seen.withColumn("_open", F.max("burst_start").over(ahead))
    return seen.withColumns({"closed_burst": F.when(idle, F.col("_p") - F.col("_open")), "_head": F.when(idle & F.col("_open").isNull(), F.col("_p"))}), part


def _moment_parts(name: str) -> list[Column]:
    """Count, sum, squared deviations, greatest and least of a column, which can be put together."""
    n = F.count(name)
    return [n.alias(f"{name}_n"), F.sum(name).alias(f"{name}_sum"), (F.var_pop(name) * n).alias(f"{name}_m2"), F.max(name).alias(f"{name}_max"), F.min(name).alias(f"{name}_min")]


def _summaries(packets: DataFrame, keys: Sequence[str], idle_seconds: float, slices: Slices | None, moments: dict[str, list[str]], measures: Sequence[Column] = ()) -> DataFrame:
    """One row per flow and slice, with the values that its border to the slice before it adds."""
    return _bordered(_slice_rows(packets, keys, idle_seconds, slices, moments, measures), keys, idle_seconds, moments)


def _slice_rows(packets: DataFrame, keys: Sequence[str], idle_seconds: float, slices: Slices | None, moments: dict[str, list[str]], measures: Sequence[Column]) -> DataFrame:
    rows, part = _within_slices(packets, keys, idle_seconds, slices)
    out = rows.groupBy(*part).agg(
        F.min("_t").alias("t0"),
        F.max("_t").alias("t1"),
        *[f(f"_t{s}").alias(f"{n}{s}") for s in ("_lo", "_hi") for f, n in ((F.min, "first"), (F.max, "last"))],
        F.min("burst_start").alias("_first_break"),
        F.max("burst_start").alias("_last_break"),
        F.count("burst_start").alias("_breaks"),
        F.max("_head").alias("_head"),
        F.min_by("from_lo", F.struct(*ORDER)).alias("_ahead"),
        *[x for name in moments for x in _moment_parts(name)],
        *measures,
    )
    return out if slices is not None else out.withColumn("_slice", F.lit(0))


def _bordered(out: DataFrame, keys: Sequence[str], idle_seconds: float, moments: dict[str, list[str]], single: bool = False) -> DataFrame:
    """Slice rows with what the border to the slice before adds; with ``single`` every flow is one slice, and no row looks at another."""
    # a flow has few slices
    before, whole = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    earlier = (lambda c: F.lit(None).cast("long")) if single else (lambda c: F.max(c).over(before))
    total = (lambda c: c) if single else (lambda c: F.sum(c).over(whole))
    out = out.withColumns({"_q": earlier("t1"), "_q_lo": earlier("last_lo"), "_q_hi": earlier("last_hi")})
    out = out.withColumns({"_b_gap": F.col("t0") - F.col("_q"), "_b_lo": F.col("first_lo") - F.col("_q_lo"), "_b_hi": F.col("first_hi") - F.col("_q_hi")})
    idle = F.coalesce(F.col("_b_gap") >= F.lit(int(idle_seconds * 1_000_000)), F.lit(False))
    opens = F.col("_q").isNull() | idle
    out = out.withColumn("_burst", F.coalesce("_last_break", F.when(opens, F.col("t0")))).withColumn("_open", earlier("_burst"))
    out = out.withColumns(
        {
            "_bursts": F.col("_breaks") + opens.cast("long"),
            "_b_idle": F.when(idle, F.col("_b_gap")),
            "_b_burst": F.when(idle, F.col("_q") - F.col("_open")),
            "_h_burst": F.when(F.col("_first_break").isNotNull(), F.col("_head") - F.when(opens, F.col("t0")).otherwise(F.col("_open"))),
        }
    )
    totals = {}
    for name, borders in moments.items():
        added = [F.col(b) for b in borders]
        totals[f"_n_{name}"] = total(sum((b.isNotNull().cast("long") for b in added), F.col(f"{name}_n")))
        values = F.filter(F.array(F.col(f"{name}_sum").cast("double"), *[b.cast("double") for b in added]), lambda x: x.isNotNull())
        totals[f"_s_{name}"] = total(F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x)))
    return out.withColumns(totals)


def _composed(moments: dict[str, list[str]], single: bool = False) -> list[Column]:
    """``_sum``, ``_avg``, ``_std``, ``_max`` and ``_min`` of each measure over the slices of a flow."""
    add, top, low = ((lambda c: c),) * 3 if single else (F.sum, F.max, F.min)
    out = []
    for name, borders in moments.items():
        n, total = F.col(f"_n_{name}"), F.col(f"_s_{name}")
        mean = total / n
        off = F.col(f"{name}_sum") / F.col(f"{name}_n") - mean
        deviations = F.coalesce(F.col(f"{name}_m2") + F.col(f"{name}_n") * off * off, F.lit(0.0))
        for b in borders:
            deviations = deviations + F.coalesce((F.col(b) - mean) * (F.col(b) - mean), F.lit(0.0))
        spread = F.try_divide(add(deviations), top(n))
        ends = [F.col(c).cast("double") for c in borders]
        out += [
            top(total).alias(f"{name}_sum"),
            F.try_divide(top(total), top(n)).alias(f"{name}_avg"),
            F.sqrt(spread).alias(f"{name}_std"),
            spread.alias(f"{name}_var"),
            top(F.greatest(F.col(f"{name}_max").cast("double"), *ends) if ends else F.col(f"{name}_max")).alias(f"{name}_max"),
            low(F.least(F.col(f"{name}_min").cast("double"), *ends) if ends else F.col(f"{name}_min")).alias(f"{name}_min"),
        ]
    return out


def interarrival_stats(packets: DataFrame, keys: Sequence[str] = FLOW_KEY, slices: Slices | None = Slices()) -> DataFrame:
    """Gap statistics per flow and direction, microseconds, 0 below two packets."""
    summaries = _summaries(packets, keys, 5.0, slices, GAP_MOMENTS)
    stats = summaries.groupBy(*keys).agg(F.min_by("_ahead", "_slice").alias("_ahead"), *_composed(GAP_MOMENTS))

    def sided(part: str, forward: bool) -> Column:
        lead, other = (f"gap_lo_{part}", f"gap_hi_{part}") if forward else (f"gap_hi_{part}", f"gap_lo_{part}")
        return _zero(F.when(F.col("_ahead"), F.col(lead)).otherwise(F.col(other)))

    parts = ("sum", "avg", "std", "max", "min")
    return stats.select(
        *keys,
        *[_zero(F.col(f"gap_{p}")).alias(f"flow_iat_{p}") for p in parts],
        *[sided(p, True).alias(f"fwd_iat_{p}") for p in parts],
        *[sided(p, False).alias(f"bwd_iat_{p}") for p in parts],
    )


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def burst_stats(packets: DataFrame, keys: Sequence[str] = FLOW_KEY, idle_seconds: float = 5.0, slices: Slices | None = Slices()) -> DataFrame:
    """Activity bursts and idle gaps per flow, microseconds."""
    summaries = _summaries(packets, keys, idle_seconds, slices, BURST_MOMENTS)
    grouped = summaries.groupBy(*keys).agg(*_burst_totals(), *_composed(BURST_MOMENTS))
    return grouped.select(*keys, F.col("_bursts").alias("burst_count"), *_burst_columns())


def _burst_totals(single: bool = False) -> list[Column]:
    add, top = (F.col, F.col) if single else (F.sum, F.max)
    return [add("_bursts").alias("_bursts"), (top("t1") - top("_burst")).alias("_last_burst")]


def _burst_columns() -> list[Column]:
    """Statistics over the closed bursts and the one still open at the end."""
    n, last = F.col("_bursts").cast("double"), F.col("_last_burst").cast("double")
    total, closed, var = _zero(F.col("closed_burst_sum")), n - 1, _zero(F.col("closed_burst_var"))
    mean = F.coalesce(F.try_divide(total, closed), F.lit(0.0))
    spread = (closed * var + (last - mean) * (last - mean) * closed / n) / n
    return [
        ((total + last) / n).alias("active_mean"),
        F.sqrt(spread).alias("active_std"),
        F.greatest(last, F.col("closed_burst_max").cast("double")).alias("active_max"),
        F.least(last, F.col("closed_burst_min").cast("double")).alias("active_min"),
        *[_zero(F.col(f"idle_gap_{source}")).alias(f"idle_{name}") for name, source in (("mean", "avg"), ("std", "std"), ("max", "max"), ("min", "min"))],
    ]


def initial_windows(packets: DataFrame, keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """TCP window of the first packet per direction, -1 where there is none."""
    keyed = packets if "from_lo" in packets.columns else with_flow_key(packets)
    grouped = keyed.groupBy(*keys).agg(
        F.min_by("from_lo", F.struct("ts", "seq")).alias("_ahead"), *_first_windows(F.struct("ts", "seq"))
    )
    return grouped.select(*keys, *_window_columns())


def _first_windows(order: Column) -> list[Column]:
    tcp = F.when(F.col("protocol") == 6, F.col("tcp_window"))
    wrapped = F.struct(tcp.alias("w"))  # a NULL window of the first packet must win, not be skipped
    return [
        F.min_by(wrapped, F.when(F.col("from_lo"), order)).alias("_w_lo"),
        F.min_by(wrapped, F.when(~F.col("from_lo"), order)).alias("_w_hi"),
    ]


def _window_columns() -> list[Column]:
    lo, hi = F.coalesce(F.col("_w_lo.w"), F.lit(-1)), F.coalesce(F.col("_w_hi.w"), F.lit(-1))
    return [
        F.when(F.col("_ahead"), lo).otherwise(hi).cast("double").alias("init_window_forward"),
        F.when(F.col("_ahead"), hi).otherwise(lo).cast("double").alias("init_window_backward"),
    ]


def flow_features(
    packets: DataFrame,
    keys: Sequence[str] = FLOW_KEY,
    idle_seconds: float = 5.0,
    slices: Slices | None = Slices(),
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """The 67 features of every flow, in contract order, after its endpoints.

    Packets are shuffled once, by flow and slice, and their summaries once more by flow.
    ``slices=None`` is for flows of bounded size. ``carry`` names extra maxima (the close
    reason of a sessionized flow, for example).
    """
    keys = list(keys)
    lo, size, head, order = F.col("from_lo"), F.coalesce(F.col("total_length"), F.lit(0)).cast("double"), F.col("transport_header_length"), F.struct(*ORDER)
    sides = {"lo": lo, "hi": ~lo}
    counts = {f"flag_{f}": F.col(f"tcp_flags.{f}") for f in FLAGS}
    counts |= {f"{f}_{s}": here & F.col(f"tcp_flags.{f}") for s, here in sides.items() for f in ("psh", "urg")}
    counts |= {f"data_{s}": here & (F.col("payload_length") > 0) for s, here in sides.items()}
    keyed = packets if "from_lo" in packets.columns else with_flow_key(packets)
    sized = keyed.withColumns({"len": size, "len_lo": F.when(lo, size), "len_hi": F.when(~lo, size), "head_lo": F.when(lo, head), "head_hi": F.when(~lo, head)})
    measures = [
        F.min_by(F.struct("src_ip", "src_port", "dst_ip", "dst_port", "from_lo"), order).alias("f"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        *[F.count_if(counts[c]).alias(c) for c in COUNTS],
        *[f(f"head_{s}").alias(f"head_{s}_{n}") for s in sides for f, n in ((F.sum, "sum"), (F.min, "min"))],
        *_first_windows(order),
        *[c.alias(name) for name, c in (carry or {}).items()],
    ]
    return features_of(_slice_rows(sized, keys, idle_seconds, slices, MOMENTS, measures), keys, idle_seconds, tuple(carry or ()), single=slices is None)


def features_of(slices: DataFrame, keys: Sequence[str], idle_seconds: float, carry: Sequence[str] = (), single: bool = False) -> DataFrame:
    """The features of flows from the summaries of their slices (numbered by ``_slice``).

    ``single``: every flow is one slice, so a row is computed by itself, without a shuffle.
    """
    keys = list(keys)
    summaries = _bordered(slices, keys, idle_seconds, MOMENTS, single)
    kept = {F.min: ("t0", "start_ts", "head_lo_min", "head_hi_min"), F.max: ("t1", "end_ts", *carry), F.sum: (*COUNTS, "head_lo_sum", "head_hi_sum")}
    ends = {"f": F.min_by("f", "_slice")} | {f"_w_{s}": F.min_by(f"_w_{s}", F.when(F.col(f"first_{s}").isNotNull(), F.col("_slice"))) for s in ("lo", "hi")}
    measures = [
        *[F.col(c) if single else ends[c].alias(c) for c in ends],
        *[F.col(c) if single else f(c).alias(c) for f, names in kept.items() for c in names],
        *[(F.col(f"_n_{name}") if single else F.max(f"_n_{name}")).alias(n) for name, n in (("len", "n"), ("len_lo", "n_lo"), ("len_hi", "n_hi"))],
        *_burst_totals(single),
        *_composed(MOMENTS, single),
    ]
    g = summaries.select(*keys, *measures) if single else summaries.groupBy(*keys).agg(*measures)
    g = g.withColumn("_ahead", F.col("f.from_lo"))

    def fwd(stem: str) -> Column:
        return F.when(F.col("_ahead"), F.col(stem.format("lo"))).otherwise(F.col(stem.format("hi")))

    def bwd(stem: str) -> Column:
        return F.when(F.col("_ahead"), F.col(stem.format("hi"))).otherwise(F.col(stem.format("lo")))

    duration = (F.col("t1") - F.col("t0")).cast("double")
    seconds = F.greatest(duration / F.lit(1e6), F.lit(RATE_FLOOR_SECONDS))
    n, n_fwd, n_bwd = F.col("n").cast("double"), fwd("n_{}").cast("double"), bwd("n_{}").cast("double")
    bytes_fwd, bytes_bwd = _zero(fwd("len_{}_sum")), _zero(bwd("len_{}_sum"))
    bursts = F.greatest(F.col("_bursts"), F.lit(1)).cast("double")
    windows, burst = _window_columns(), _burst_columns()
    port = F.coalesce(F.col("f.dst_port"), F.lit(-1)).cast("double")
    ordered = [
        port,
        duration,
        n_fwd,
        n_bwd,
        bytes_fwd,
        bytes_bwd,
        *[_zero(fwd("len_{}_" + m)) for m in ("max", "min", "avg", "std")],
        *[_zero(bwd("len_{}_" + m)) for m in ("max", "min", "avg", "std")],
        (bytes_fwd + bytes_bwd) / seconds,
        n / seconds,
        *[_zero(F.col(f"gap_{m}")) for m in ("avg", "std", "max", "min")],
        *[_zero(fwd("gap_{}_" + m)) for m in ("sum", "avg", "std", "max", "min")],
        *[_zero(bwd("gap_{}_" + m)) for m in ("sum", "avg", "std", "max", "min")],
        fwd("psh_{}").cast("double"),
        fwd("urg_{}").cast("double"),
        _zero(fwd("head_{}_sum")),
        _zero(bwd("head_{}_sum")),
        n_fwd / seconds,
        n_bwd / seconds,
        F.col("len_min"),
        F.col("len_max"),
        F.col("len_avg"),
        F.col("len_std"),
        F.col("len_var"),
        *[F.col(f"flag_{f}").cast("double") for f in FLAGS],
        _zero(F.try_divide(n_bwd, n_fwd)),
        (bytes_fwd + bytes_bwd) / n,
        _zero(fwd("len_{}_avg")),
        _zero(bwd("len_{}_avg")),
        bytes_fwd / bursts,
        bytes_bwd / bursts,
        *windows,
        fwd("data_{}").cast("double"),
        _zero(fwd("head_{}_min")),
        *burst,
    ]
    named = [c.alias(name) for c, name in zip(ordered, FLOW_FEATURES, strict=True)]
    return g.select(
        *[k for k in keys if k not in FLOW_KEY or k == "protocol"],
        *[F.col(f"f.{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")],
        "start_ts",
        "end_ts",
        *carry,
        *named,
    )


def feature_quality(features: DataFrame) -> DataFrame:
    """Per feature: its quality class (A read directly, B approximated) and how many flows hold a finite value."""
    names = [c for c in FLOW_FEATURES if c in features.columns]
    value = [F.col(f"`{c}`").cast("double") for c in names]
    filled = features.agg(*[F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).alias(f"n{i}") for i, v in enumerate(value)])
    rows = [F.struct(F.lit(n).alias("feature"), F.lit("B" if n in APPROXIMATED_FEATURES else "A").alias("quality"), F.col(f"n{i}").alias("filled")) for i, n in enumerate(names)]
    return filled.select(F.inline(F.array(*rows)))
