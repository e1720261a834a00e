"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Strict patterns give the seed entities, each an instance whatever its digits and spaces. Every identifier-like
token of the corpus is linked to the lexical patterns around it (the word before, the word after, both; one
alone where the other side has no word); seeds give those patterns a confidence for each
kind, patterns pass it on to the tokens they surround, and so on for a few rounds. Tokens that patterns of high
confidence agree on become further spans; seeds always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3  # distinct seed instances that a pattern needs
CONFIDENCE = 0.8
PATTERNS_TO_AGREE = 2  # all, of an instance that has fewer
CONTEXT = 60  # characters on either side that hold the neighbouring word

# The seed patterns, each with what is checked of a match. They are written so that the regular
# expression engine neither recurses nor starts twice in one run of characters: places that would end a
# repeated group are first replaced by a character of the same width (_LEVEL), which leaves plain runs.
_LOCAL = "A-Za-z0-9._%+-"
_LEVEL = {"email": (r"\.(?![A-Za-z0-9-])", "_"), "card": (r"[ -](?![0-9])", "x")}
_FIND = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_GROUPS = (r"(?<=[0-9)]) (?=\(?[0-9])", "_")  # makes one token of groups of digits
_SPAN = "array<struct<kind:string,start:int,end:int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap condition without which the text has no match."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
            "card": text.rlike("[0-9](?:[ -]?[0-9]){15}"), "phone": text.contains("+")}[kind]


def _found(text: Column, pattern: str) -> Column:
    """``(gap, m)`` in order: the text before each match and the match; a last one with a null match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))


def seed_spans(text: Column, kind: str) -> Column:
    """Spans (kind, start, end; code points, end exclusive) of one kind, leftmost and without overlap."""
    level = F.regexp_replace(text, *_LEVEL[kind]) if kind in _LEVEL else text
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        holds = x["m"].isNotNull() & _holds(kind, x["m"])
        return F.struct(end.alias("pos"), F.when(holds, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(_found(level, _FIND[kind]), F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(_may_hold(kind, text), walked).otherwise(none)


def _word(text: Column, last: bool) -> Column:
    near = F.substring(text, -CONTEXT, CONTEXT) if last else F.substring(text, 1, CONTEXT)
    return F.lower(F.regexp_replace(F.regexp_extract(near, r"(\S+)\s*$" if last else r"^\s*(\S+)", 1), r"[^\p{L}=:#]", ""))


def _instances(text: Column, spans: Column) -> Column:
    """Seed spans as (start, end, instance, before, after, kind), with the words around them."""

    def one(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.regexp_replace(F.substring(text, begin + 1, s["start"] - begin), r"[^\p{L}0-9\s=:#]+$", "")
        after = F.regexp_replace(F.substring(text, s["end"] + 1, F.lit(CONTEXT)), r"^[^\p{L}0-9\s]+", "")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("instance"),
                        _word(before, True).alias("before"), _word(after, False).alias("after"), s["kind"].alias("kind"))

    return F.transform(spans, one)


def _identifier(core: Column) -> Column:
    return core.contains("@") | (F.length(_digits(core)) >= 4) | core.rlike(r"[0-9]\.[0-9]++\.[0-9]")


def tokens(text: Column) -> Column:
    """Identifier-like tokens: (start, end, instance, before, after), trimmed of punctuation.

    They have four digits or more, groups of digits between spaces taken together, or an ``@``, or three numbers with dots between.
    """
    text = F.regexp_replace(text, *_GROUPS)
    kind = "array<struct<start:int,end:int,instance:string,before:string,after:string>>"

    def step(acc: Column, x: Column) -> Column:
        opened = F.length(F.regexp_extract(x["m"], r"^[^\p{L}0-9+]*", 0))
        core = F.regexp_replace(x["m"], r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "")
        start = acc["pos"] + F.length(x["gap"]) + opened
        own = F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("instance"),
                       _word(x["gap"], True).alias("before"), F.lit("").alias("after"))
        after = _word(x["gap"], False)
        # the word after a token stands in the next gap: complete the token before
        last = F.size(acc["out"]) - 1
        out = F.when(acc["open"], F.concat(F.slice(acc["out"], 1, F.greatest(last, F.lit(0))), F.array(F.struct(
            F.get(acc["out"], last)["start"].alias("start"), F.get(acc["out"], last)["end"].alias("end"),
            F.get(acc["out"], last)["instance"].alias("instance"), F.get(acc["out"], last)["before"].alias("before"),
            after.alias("after"))))).otherwise(acc["out"])
        keep = x["m"].isNotNull() & _identifier(core)
        return F.struct(
            (acc["pos"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"),
            F.coalesce(keep, F.lit(False)).alias("open"),
            F.when(keep, F.concat(out, F.array(own))).otherwise(out).alias("out"))

    none = F.array().cast(kind)
    first = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("open"), none.alias("out"))
    return F.when(text.rlike("[0-9@]"), F.aggregate(_found(text, _TOKEN), first, step, lambda acc: acc["out"])).otherwise(none)


def scored_instances(seen: DataFrame) -> DataFrame:
    """``(kind, instance)`` of tokens that are no seeds but that confident patterns agree on.

    ``seen`` has a row for each token: instance, before, after, kind (of the seed span it lies in, else null).
    Edges are counted once for each pattern and instance before any join, and scores move along them by joins
    and sums alone, so neither a common pattern nor a common token gathers its rows in one place.
    """
    before, after = F.col("before") != "", F.col("after") != ""
    pattern = F.explode(F.array_compact(F.array(
        F.when(before, F.concat(F.lit("< "), "before")), F.when(after, F.concat(F.lit("> "), "after")),
        F.when(before & after, F.concat(F.lit("<> "), F.concat_ws(" ", "before", "after"))))))
    edges = stage(seen.filter(before | after)
                  .select("instance", "kind", pattern.alias("pattern"))
                  .groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    kinds = F.explode(F.array(*map(F.lit, KINDS)))
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter(F.col("seed").isNotNull())
    supported = seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= SUPPORT)
    patterns = stage(supported.join(size, "pattern").select("pattern", "kind", "seeds", "n"))
    confidence = patterns.select("pattern", "kind", (F.col("seeds") / (F.col("n") + 1)).alias("score"))
    open_edges = edges.filter(F.col("seed").isNull()).select("pattern", "instance")
    patterns_of = open_edges.groupBy("instance").agg(F.count("*").alias("edges"))
    instances = None
    for _ in range(ROUNDS):
        instances = stage(open_edges.join(confidence, "pattern").groupBy("instance", "kind").agg(
            F.avg("score").alias("score"), F.count_if(F.col("score") >= CONFIDENCE).alias("agree")))
        gained = open_edges.join(instances, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
        confidence = patterns.join(gained, ["pattern", "kind"], "left").select(
            "pattern", "kind", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + 1)).alias("score"))
    confident = instances.filter((F.col("score") >= CONFIDENCE) & (F.col("agree") >= 1)).join(patterns_of, "instance")
    return confident.filter(F.col("agree") >= F.least(F.lit(PATTERNS_TO_AGREE), "edges")).groupBy("instance").agg(
        F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def find(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, ``base`` (seed spans) and ``spans`` (all spans), by kind as listed, then start.

    Null and empty texts have no spans. Texts are read whole; repeated rows are treated alike; an empty table
    gives an empty one; other columns are not read. Two kinds may overlap each other. One row for each document is
    staged, with its positions and ``keep``. Spans that the method adds are staged as well and joined to it: ``keep`` is
    shuffled only where these are too many to broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(df.select(
        *keep, F.concat(*[seed_spans(text, k) for k in KINDS]).alias("base"), text.alias("__text"),
    ).select(
        *keep, "base", _instances(F.col("__text"), F.col("base")).alias("seeds"), tokens(F.col("__text")).alias("tokens"),
    ).withColumn("__row", F.monotonically_increasing_id()))
    seen = rows.select("__row", "base", F.explode("tokens").alias("t")).filter(
        ~F.exists("base", lambda s: (s["start"] < F.col("t.end")) & (F.col("t.start") < s["end"]))).select("__row", "t.*", F.lit(None).cast("string").alias("kind"))
    new = scored_instances(seen.unionByName(rows.select("__row", F.inline("seeds"))))
    more = stage(seen.drop("kind").join(new, "instance")
                 .groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return rows.join(more, "__row", "left").select(*keep, "base", F.array_sort(
        F.concat("base", F.coalesce("more", F.array().cast(_SPAN))),
        lambda a, b: F.signum((order[a["kind"]] - order[b["kind"]]) * F.lit(1e12) + a["start"] - b["start"]).cast("int")).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first one names the place."""
    by_start = F.array_sort(spans, lambda a, b: F.signum((a["start"] - b["start"]) * F.lit(1e10) + a["end"] - b["end"]).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], piece).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(by_start, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(walked["out"], F.substring(text, walked["pos"] + 1, F.length(text))))
