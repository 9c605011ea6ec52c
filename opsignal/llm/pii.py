"""Personal data: fixed patterns, and identifiers found by the contexts that the certain ones appear in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

KINDS = ("email", "ip", "card", "phone")
# The same matches as the plain expressions, in linear time: quantifiers give nothing back where nothing could
# follow, and a match starts at the start of a run of characters or right after the last match.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A word that holds a digit or @, and such words next to each other: what an identifier could be.
SINGLE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
RUN = SINGLE + r"(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
AROUND = ".,;:!?\"'()[]{}<>|*"

ROUNDS = 3
#: A pattern counts from this precision and so many instances; an instance from this score.
PRECISION, SUPPORT, ACCEPT = 0.8, 5.0, 0.9


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits, every second from the right doubled, add up to a multiple of ten."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match is kept."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.when(part(p), F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False)
        return F.forall(F.split(match, r"\."), small)
    n = F.length(digits(match))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(match))).otherwise(False)
    return n.between(9, 15)


#: Matches that are handled together: adding to a list copies it, so lists are grown in two levels.
CHUNK = 256


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(items: Column) -> Column:
    """An array cut into arrays of CHUNK."""
    count = F.ceil(F.size(items) / CHUNK).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(items) > 0, pieces).otherwise(F.array(items))


def placed(text: Column, expression: str) -> Column:
    """Array of (match, start, end, before, after) in code points, with the text between a match and its neighbours:
    lengths of gaps and matches, added up."""
    found = "array<struct<match:string,start:int,end:int,before:string,after:string>>"

    def spread(matches: Column, gaps: Column) -> Column:
        n = F.size(matches)
        steps = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("h"))

        def step(done: Column, x: Column) -> Column:
            start = done["at"] + F.length(x["g"])
            end = start + F.length(x["m"])
            one = F.struct(x["m"].alias("match"), start.alias("start"), end.alias("end"), x["g"].alias("before"), x["h"].alias("after"))
            return F.struct(end.alias("at"), F.concat(done["found"], F.array(one)).alias("found"))

        def chunk(done: Column, items: Column) -> Column:
            empty = F.struct(done["at"].alias("at"), F.array().cast(found).alias("found"))
            return bound(F.aggregate(items, empty, step), lambda c: F.struct(c["at"].alias("at"), F.concat(done["all"], F.array(c["found"])).alias("all")))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{found}>").alias("all"))
        return bound(steps, lambda s: F.flatten(F.aggregate(chunks(s), none, chunk)["all"]))

    pair = F.struct(F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("m"), F.split(text, expression, -1).alias("g"))
    return bound(pair, lambda p: spread(p["m"], p["g"]))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end), sorted; kind is the place in KINDS."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, kind in enumerate(KINDS):
        sign = F.instr(text, "@" if kind == "email" else "+" if kind == "phone" else ".") > 0 if kind != "card" else F.lit(True)
        digit = F.lit(True) if kind == "email" else text.rlike("[0-9]")
        good = F.filter(placed(text, EXPRESSIONS[kind]), lambda s: holds(kind, s["match"]))  # noqa: B023
        spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))  # noqa: B023
        found.append(F.when(sign & digit, spans).otherwise(none))
    return F.array_sort(F.concat(*found))


BLANK_TO_SPACE = ("\t\n\x0b\f\r", "     ")


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def words_before(gap: Column) -> tuple[Column, Column]:
    """The last word, and the last two with a space between; empty where there are not so many."""
    text = F.rtrim(F.translate(gap, *BLANK_TO_SPACE))
    last = F.substring_index(text, " ", -1)
    rest = F.rtrim(F.left(text, F.length(text) - F.length(last)))
    before = F.substring_index(rest, " ", -1)
    return _plain(last), F.when(before != "", F.concat(_plain(before), F.lit(" "), _plain(last))).otherwise("")


def word_after(gap: Column) -> Column:
    return _plain(F.substring_index(F.ltrim(F.translate(gap, *BLANK_TO_SPACE)), " ", 1))


def candidates(text: Column, base: Column, expression: str) -> Column:
    """Array of (name, start, end, kind, patterns): what could be an identifier, the kind of the base span it
    touches (null: none), and the lexical patterns it stands in. Base spans are looked up among those that
    touch the same CHUNK of candidates."""
    kind = "array<struct<name:string,start:int,end:int,kind:int,patterns:array<string>>>"

    def describe(x: Column, near: Column) -> Column:
        bare = F.ltrim(x["match"], F.lit(AROUND))
        start = x["start"] + F.length(x["match"]) - F.length(bare)
        bare = F.rtrim(bare, F.lit(AROUND))
        touching = F.filter(near, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        # another candidate stands right beside it
        beside = lambda gap, word: F.when((gap == " ") & (word == ""), "#").otherwise(word)
        left, two = words_before(x["before"])
        left, right = beside(x["before"], left), beside(x["after"], word_after(x["after"]))
        patterns = F.array(
            F.when(left != "", F.concat(F.lit("L "), left)),
            F.when(two != "", F.concat(F.lit("LL "), two)),
            F.when(right != "", F.concat(F.lit("R "), right)),
            F.when((left != "") & (right != ""), F.concat(F.lit("LR "), left, F.lit(" _ "), right)),
        )
        return F.struct(
            F.lower(bare).alias("name"), start.alias("start"), (start + F.length(bare)).alias("end"),
            F.get(touching, F.lit(0))["kind"].alias("kind"), F.array_compact(patterns).alias("patterns"),
        )

    def together(items: Column, spans: Column) -> Column:
        first, last = F.get(items, F.lit(0))["start"], F.element_at(items, -1)["end"]
        near = F.filter(spans, lambda b: (b["start"] < last) & (b["end"] > first))
        return bound(near, lambda n: F.transform(items, lambda x: describe(x, n)))

    def every(found: Column, spans: Column) -> Column:
        return F.flatten(F.transform(chunks(found), lambda items: F.when(F.size(items) > 0, together(items, spans)).otherwise(F.array().cast(kind))))

    pair = F.struct(placed(text, expression).alias("found"), base.alias("spans"))
    return F.when(text.rlike("[0-9@]"), bound(pair, lambda p: every(p["found"], p["spans"]))).otherwise(F.array()).cast(kind)


def runs(text: Column, base: Column) -> Column:
    """Candidates of both sizes: single words, and runs of several."""
    several = F.filter(candidates(text, base, RUN), lambda r: F.instr(r["name"], " ") > 0)
    return F.concat(candidates(text, base, SINGLE), several)


def bootstrapped(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(name, kind) of instances that are no seeds but stand in patterns of seeds.

    ``instances``: name, kind (null: unknown), pattern; one row per occurrence and pattern. A pattern's
    precision for a kind is the summed score of its instances of the kind over one more than all its
    instances; those above PRECISION with at least SUPPORT vote. An instance's score is one minus the product
    of what the votes leave open; from ACCEPT on it counts in the next round.
    """
    edges = staged(instances.groupBy("pattern", "name").agg(F.min("kind").alias("kind")), "edges")
    seeds = edges.where("kind IS NOT NULL").groupBy("name").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = staged(seeds, "seeds")
    open_edges = staged(edges.select("pattern", "name").join(seeds.select("name"), "name", "left_anti"), "open-edges")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    trusted, found = seeds, None
    for _ in range(rounds):
        votes = (
            edges.select("pattern", "name").join(trusted, "name").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
            .where(F.col("mass") >= SUPPORT).join(size, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("n") + 1)).alias("precision"))
            .where(F.col("precision") >= PRECISION)
        )
        votes = staged(votes, "patterns")
        scored = open_edges.join(votes, "pattern").groupBy("name", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("precision", F.lit(0.999999)))))).alias("score"))
        best = scored.where(F.col("score") >= ACCEPT).groupBy("name").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        found = staged(best.select("name", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score")), "found")
        trusted = seeds.unionByName(found)
    return found.select("name", "kind")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end) in code points, sorted by start, then kind.

    ``base`` holds the matches of the four expressions that pass their checks. Their contexts (one and two
    words before, one after, both sides) make patterns; patterns in which nearly all instances are of one
    kind add further identifiers to ``spans``. Spans that touch a base span are not added. Of words with digits
    side by side each is a candidate, and all together; both may be found. Time is linear in the text.

    Cases: null and empty texts have no spans. Every row is a document: rows that repeat doc_id and text get
    the same spans. Null doc_ids are kept. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.col("text")
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", F.unhex(F.md5(text)).alias("digest"), "text", base_spans(text).alias("base"))
    rows = staged(rows.select("doc_id", "digest", "base", runs(text, F.col("base")).alias("runs")), "identifiers")
    each = rows.select("doc_id", "digest", F.explode("runs").alias("r")).select("doc_id", "digest", "r.*")
    patterns = each.select("name", "kind", F.explode("patterns").alias("pattern")).where("name != ''")
    added = bootstrapped(patterns, rounds).withColumnRenamed("kind", "k")
    new = (
        each.where("kind IS NULL").join(added, "name").groupBy("doc_id", "digest")
        .agg(F.collect_set(F.struct(F.col("start"), F.col("k").alias("kind"), F.col("end"))).alias("new"))
        .withColumnsRenamed({"doc_id": "_d", "digest": "_t"})
    )
    both = rows.join(new, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_t")), "left")
    none = F.array().cast(rows.schema["base"].dataType)
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", none))).alias("spans"))


def printed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
