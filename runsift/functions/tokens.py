"""Token-list operations on array<int> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_subsequence(values: Column, part: Column, start: Column | int = 0) -> Column:
    """0-based first position of ``part`` in ``values`` from ``start`` on; null when absent."""
    start = F.lit(start) if isinstance(start, int) else start
    last = F.size(values) - F.size(part)
    spots = F.when((last >= start) & (F.size(part) > 0), F.sequence(start.cast("int"), last.cast("int")))
    hits = F.filter(spots, lambda i: (values[i] == part[0]) & (F.slice(values, i + 1, F.size(part)) == part))
    return F.try_element_at(hits, F.lit(1))


def first_stop(values: Column, stops: Column, start: Column | int = 0) -> Column:
    """0-based position of the first stop token from ``start`` on; null when there is none."""
    start = F.lit(start) if isinstance(start, int) else start
    marked = F.transform(values, lambda v, i: F.when((i >= start) & F.array_contains(stops, v), i))
    return F.array_min(marked)


def trim_at_stop(values: Column, stops: Column, inclusive: bool = False) -> Column:
    n = F.coalesce(first_stop(values, stops) + (1 if inclusive else 0), F.size(values))
    return F.slice(values, F.lit(1), n.cast("int"))


def _cut(values: Column, start: Column, end: Column) -> Column:
    return F.slice(values, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def split_channels(df: DataFrame, prefix: Column, generated: Column, open_ids: Column, boundary_ids: Column,
                   stop_ids: Column, limit: Column, finish_reason: Column) -> DataFrame:
    """Adds thought ids, answer ids, parse status and truncation of one response per row.

    Each position is its own column first: used inside the next array function
    it is then a plain reference and not an expression evaluated per element.
    """
    truncated = F.coalesce(finish_reason == "length", F.lit(False)) | (finish_reason.isNull() & (F.size(generated) >= limit))
    out = df.withColumns({"__resp": F.concat(prefix, generated), "truncated": truncated})
    resp = F.col("__resp")
    out = out.withColumn("open_index", find_subsequence(resp, open_ids))
    out = out.withColumn("__content", F.col("open_index") + F.size(open_ids))
    content = F.col("__content")
    out = out.withColumn("__from", F.coalesce(content, F.lit(0)))
    out = out.withColumn("boundary_index", F.when(content.isNotNull(), find_subsequence(resp, boundary_ids, F.col("__from"))))
    out = out.withColumn("__after", F.col("boundary_index") + F.size(boundary_ids))
    out = out.withColumn("__from", F.coalesce("__after", F.lit(0)))
    out = out.withColumn("stop_index", F.coalesce(first_stop(resp, stop_ids, F.col("__from")), F.size(resp)))
    boundary, after, stop, empty = F.col("boundary_index"), F.col("__after"), F.col("stop_index"), F.slice(resp, 1, 0)
    no_open, no_boundary = content.isNull(), boundary.isNull()
    out = out.withColumns({
        "parse_status": F.when(no_open, "missing_reasoning_open").when(no_boundary, "missing_answer_boundary").otherwise("ok"),
        "thought_ids": F.when(no_open, empty).otherwise(_cut(resp, content, F.coalesce(boundary, stop))),
        "answer_ids": F.when(no_open, F.slice(resp, F.lit(1), stop.cast("int"))).when(no_boundary, empty).otherwise(_cut(resp, after, stop)),
    })
    return out.drop("__resp", "__content", "__from", "__after")


def summarise_continuation(generated: Column, stop_ids: Column, limit: Column | int, endpoint: int) -> Column:
    """Answer ids up to the first stop, the first-N endpoint and the stop reason."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    stop = first_stop(generated, stop_ids)
    answer = trim_at_stop(generated, stop_ids)
    reason = (
        F.when(stop.isNotNull(), "registered_terminal").when(F.size(generated) >= limit, "max_new_tokens")
        .otherwise("backend_stop_without_registered_terminal")
    )
    return F.struct(
        answer.alias("answer_ids"), F.slice(answer, 1, endpoint).alias("endpoint_ids"),
        generated[stop].alias("terminal_id"), reason.alias("stop_reason"), (reason == "max_new_tokens").alias("truncated"),
    )


def boundary_prefix(prompt: Column, response_prefix: Column, generated: Column, boundary_ids: Column) -> Column:
    """Input ids plus the generated ids up to and including the boundary marker; null without one."""
    at = find_subsequence(F.concat(response_prefix, generated), boundary_ids)
    take = F.greatest(at + F.size(boundary_ids) - F.size(response_prefix), F.lit(0))
    return F.concat(prompt, F.slice(generated, F.lit(1), take.cast("int")))


def source_mask(ids: Column, question: tuple[Column, Column], trace: tuple[Column, Column], structural: Column, condition: Column) -> Column:
    """0/1 mask over the ids: the chosen spans are hidden, structural ids stay visible."""
    hide_q, hide_t = condition.isin("question", "joint"), condition.isin("trace", "joint")
    inside = lambda i, span: (i >= span[0]) & (i < span[1])
    mask = F.transform(
        ids,
        lambda v, i: F.when(
            ((hide_q & inside(i, question)) | (hide_t & inside(i, trace))) & ~F.array_contains(structural, v), 0
        ).otherwise(1),
    )
    return mask


def masked_count(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m == 0))


def token_safe_cut(df: DataFrame, pieces: Column, ratio: float, name: str = "cut") -> DataFrame:
    """Adds the best cut of a token list near ``ratio`` as struct(quality, distance, cut).

    The text before a cut decides its quality: sentence or line end, white
    space, clause end, bare token.  Order: quality, distance, position.  Null
    for fewer than 12 tokens.
    """
    half_even = lambda c: F.bround(c).cast("int")
    out = df.withColumns({"__p": pieces}).withColumn("__n", F.size("__p"))
    n, p = F.col("__n"), F.col("__p")
    out = out.withColumns({
        "__target": F.greatest(F.lit(4), F.least(n - 2, half_even(n * F.lit(ratio)))),
        "__radius": F.greatest(F.lit(8), half_even(n * F.lit(0.12))),
    })
    target, radius = F.col("__target"), F.col("__radius")
    cuts = F.sequence(F.greatest(F.lit(4), target - radius), F.least(n - 1, target + radius))

    def text_before(cut: Column) -> Column:
        # The last 32 pieces decide unless they hold nothing but blanks and closers.
        tail = F.array_join(F.slice(p, F.greatest(cut - 31, F.lit(1)), F.least(cut, F.lit(32))), "")
        return F.struct(cut.alias("cut"), tail.alias("text"))

    def settle(s: Column) -> Column:
        whole = F.array_join(F.slice(p, F.lit(1), s["cut"]), "")
        solid = s["text"].rlike(r"""(?U)[^\s"')\]]""")
        return F.struct(s["cut"].alias("cut"), F.when(solid, s["text"]).otherwise(whole).alias("text"))

    def rank(s: Column) -> Column:
        text = s["text"]
        quality = (
            F.when(text.rlike(r"""(?U)([.!?]["')\]]*|\n)\s*$"""), 0).when(text.rlike(r"[ \n\t]$"), 1)
            .when(text.rlike(r"(?U)[,;:]\s*$"), 2).otherwise(3)
        )
        return F.struct(quality.alias("quality"), F.abs(s["cut"] - target).alias("distance"), s["cut"].alias("cut"))

    texts = F.transform(F.transform(cuts, text_before), settle)
    out = out.withColumn(name, F.when(n >= 12, F.array_min(F.transform(texts, rank))))
    return out.drop("__p", "__n", "__target", "__radius")


def prefixes_at(pieces: Column, ks: list[int]) -> Column:
    """Text of the first k tokens for each k not above the token count, as map<int, string>."""
    usable = F.filter(F.array(*map(F.lit, ks)), lambda k: k <= F.size(pieces))
    return F.map_from_arrays(usable, F.transform(usable, lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "")))


def first_visible_token(df: DataFrame, pieces: Column, targets: dict[str, Column], name: str = "visible") -> DataFrame:
    """Adds the smallest token count whose text shows one of the targets, and which one.

    A target shows once its last character is inside the prefix, so its end
    position in the whole text is matched against cumulative piece lengths;
    no prefix is built.
    """
    out = df.withColumn("__p", pieces).withColumn("__text", F.array_join("__p", ""))
    text = F.col("__text")
    ends = F.array(*[
        F.when(F.position(p, text) > 0, F.struct((F.position(p, text) + F.length(p) - 1).alias("end"), F.lit(state).alias("state")))
        for state, p in targets.items()
    ])
    out = out.withColumn("__first", F.array_min(F.filter(ends, lambda e: e.isNotNull())))
    end = F.col("__first.end")
    walked = F.aggregate(
        "__p", F.struct(F.lit(0).alias("seen"), F.lit(0).alias("count")),
        lambda acc, x: F.struct((acc["seen"] + F.length(x)).alias("seen"), (acc["count"] + (acc["seen"] < end).cast("int")).alias("count")),
    )
    hit = F.col("__first").isNotNull()
    out = out.withColumn(name, F.when(hit, F.struct(walked["count"].alias("token"), F.col("__first.state").alias("state"))))
    return out.drop("__p", "__text", "__first")
