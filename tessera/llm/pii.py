r"""Personal data: patterns for four kinds, and contexts that are learnt from what these find.

Spans of the four patterns are the seeds.  The word in front of a seed is a lexical pattern; tokens that look like
identifiers (with a digit or an ``@``) are instances, wherever they stand.  Patterns and instances form a graph whose
edges are occurrences.  A pattern's score is the scored share of all that follows it in the corpus, an instance's score
the chance that one of its patterns is right, seeds being certain; both are computed in turn, a fixed number of times.
Instances after patterns of high confidence become spans of the kind that the pattern's seeds mostly have.

All of it is DataFrame and SQL expressions.  The patterns are written without ambiguous repetition, so that the
engine neither backtracks nor recurses on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: Equivalent to the plain patterns: a run is entered at its beginning or where the last match ended, and never given up.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that fails this has no span of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: What matches must also meet; ``m`` is the match.
HOLDS = {
    "email": "true",
    "ip": r"forall(split(m, '\\.'), x -> length(regexp_replace(x, '^0+', '')) < 4 AND coalesce(try_cast(substring(regexp_replace(x, '^0+', ''), 1, 4) AS int), 0) < 256)",
    "card": r"length(regexp_replace(m, '[^0-9]', '')) BETWEEN 16 AND 19 AND luhn_check(regexp_replace(m, '[^0-9]', ''))",
    "phone": r"length(regexp_replace(m, '[^0-9]', '')) BETWEEN 8 AND 15",
}
#: Tokens that look like identifiers: they begin after white space or a sign, and hold a digit or an at sign.
TOKEN = r"""(?<![^\s=:"'(<\[])[^\s0-9@=:"'(<\[]*+[0-9@][^\s"'<>)\],;]*+"""
TOKEN_HOLDS = r"length(m) >= 6 AND (length(regexp_replace(m, '[^0-9]', '')) >= 3 OR m LIKE '%_@_%')"
#: Code points looked at in front of an instance for its pattern.
BEFORE = 48


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str, pattern: str, holds: str) -> str:
    """Spans (kind, start, end) of the matches that hold, in code points.  Each match is looked at once, from the pieces
    between matches; only those that hold are gathered."""
    made = f"named_struct('kind', '{kind}', 'start', a.at + length(p[i]), 'end', a.at + length(p[i]) + length(m))"
    fold = f"""aggregate(sequence(0, size(ms) - 1),
        named_struct('at', 0, 'got', cast(array() AS array<struct<kind:string,start:int,end:int>>)),
        (a, i) -> named_struct(
            'at', a.at + length(p[i]) + length(ms[i]),
            'got', transform(array(ms[i]), m -> if({holds}, concat(a.got, array({made})), a.got))[0]),
        a -> a.got)"""
    # a lambda over one element names the two arrays
    pair = f"array(named_struct('ms', regexp_extract_all(t, {pattern}, 0), 'p', split(t, {pattern}, -1)))"
    body = fold.replace("size(ms)", "size(q.ms)").replace("ms[i]", "q.ms[i]").replace("p[i]", "q.p[i]")
    return f"transform({pair}, q -> if(size(q.ms) = 0, cast(array() AS array<struct<kind:string,start:int,end:int>>), {body}))[0]"


def base_spans(text: Column | str = "t") -> Column:
    """Spans of the four kinds, by kind as listed, then by start.  ``text``: the name of a column that is not null."""
    none = "cast(array() AS array<struct<kind:string,start:int,end:int>>)"
    parts = [f"if(t RLIKE {_quoted(NEEDS[k])}, {_spans(k, _quoted(PATTERNS[k]), HOLDS[k])}, {none})" for k in KINDS]
    return F.expr(f"concat({', '.join(parts)})".replace("(t,", f"({text},").replace("if(t ", f"if({text} "))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _in_order(spans: Column) -> Column:
    rank = F.create_map(*(x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))))
    keyed = F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _context(t: str, start: str) -> str:
    """The word in front of a place, in small letters: with what is attached to it, or else the one before the blank."""
    return f"lower(regexp_extract(substring({t}, greatest(1, {start} + 1 - {BEFORE}), least({start}, {BEFORE})), '(\\\\S+)\\\\s*$', 1))"


def found(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h`` (hash of the text), ``base`` and ``seen``: every base span and every other identifier-like token
    with its pattern and its own text.  Equal rows have equal results, so id and hash identify a row."""
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t")).withColumn("base", base_spans())
    tokens = f"if(t RLIKE '[0-9@]', {_spans('', _quoted(TOKEN), TOKEN_HOLDS)}, cast(array() AS array<struct<kind:string,start:int,end:int>>))"
    free = f"filter({tokens}, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end))"
    seen = f"transform(concat(base, {free}), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'pattern', {_context('t', 's.start')}, 'own', lower(substring(t, s.start + 1, s.end - s.start))))"
    return base.select("id", "h", "base", F.expr(seen).alias("seen"))


def confident_patterns(docs: DataFrame, seen: DataFrame, *, text_col: str = "text", rounds: int = 3, confidence: float = 0.8, least_seeds: int = 5) -> DataFrame:
    """``pattern``, ``kind``: the patterns of high confidence.  ``seen``: rows of ``pattern``, ``own``, ``kind``.

    Occurrences are added up by (pattern, instance) first, so that neither a common pattern nor a common instance is
    ever one task's rows.  What follows a pattern is counted over every word of the corpus.
    """
    edges = seen.where("pattern <> ''").groupBy("pattern", "own").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") != "", F.col("kind"))).alias("kind"))
    edges = written(edges, "pii-edges")
    sums = edges.groupBy("pattern").agg(F.sum("n").alias("all"), F.count("kind").alias("seeds"))
    likely = sums.where(F.col("seeds") >= least_seeds)
    words = docs.select(F.explode(F.split(F.lower(text_of(text_col)), r"\s+")).alias("pattern")).where("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("words"))
    totals = likely.join(words, "pattern", "left").select("pattern", F.greatest("all", F.coalesce("words", F.lit(0))).alias("total"))
    # only patterns with seeds enough can ever score high: the rest of the graph is left out
    graph = written(edges.join(totals, "pattern"), "pii-graph")
    scores = graph.select("own", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score")).groupBy("own").agg(F.max("score").alias("score"))
    seeds = scores
    for _ in range(rounds):
        patterns = graph.join(scores, "own").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("p"))
        missed = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9))))
        reached = graph.join(patterns, "pattern").groupBy("own").agg((1 - F.exp(missed)).alias("reached"))
        scores = seeds.join(reached, "own").select("own", F.greatest("score", "reached").alias("score"))
    good = graph.join(scores, "own").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("p")).where(F.col("p") >= confidence)
    kinds = graph.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    return good.join(kinds, "pattern").select("pattern", "kind")


def all_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id``, ``h``, ``base``, ``spans`` of every row: base spans, and all spans with those that contexts add.

    Null texts count as empty, null ids and repeated rows stay, and other columns are ignored.
    """
    rows = written(found(docs, id_col=id_col, text_col=text_col), "pii-found")
    each = rows.select("id", "h", F.explode("seen").alias("s")).select("id", "h", "s.*")
    patterns = confident_patterns(docs, each, text_col=text_col, **options)
    new = each.where("kind = ''").drop("kind").join(patterns, "pattern").select("id", "h", F.struct("kind", "start", "end").alias("s"))
    added = new.groupBy("id", "h").agg(F.collect_set("s").alias("added"))
    r, a = rows.drop("seen").alias("r"), added.alias("a")
    both = r.join(a, F.col("r.id").eqNullSafe(F.col("a.id")) & (F.col("r.h") == F.col("a.h")), "left")
    return both.select("r.id", "r.h", "r.base", F.when(F.col("a.added").isNull(), F.col("r.base")).otherwise(_in_order(F.concat("r.base", "a.added"))).alias("spans"))


def pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Counts by kind and digest of the base spans, and all spans, of every document."""
    got = all_spans(docs, id_col=id_col, text_col=text_col, **options)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS long) AS n_{k}") for k in KINDS]
    return got.select(F.col("id").alias(id_col), *counts, F.sha2(F.encode(_listed("base"), "UTF-8"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets (overlapping spans by that of the first).

    Null texts stay null.  Only rows with spans are matched to them by id and hash."""
    kept = docs.columns
    got = all_spans(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).select("id", "h", "spans").distinct().alias("g")
    mark = fresh(docs, "hash")
    rows = docs.withColumn(mark, F.xxhash64(text_of(text_col))).alias("d")
    both = rows.join(got, F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.col(f"d.{mark}") == F.col("g.h")), "left")
    ordered = "array_sort(transform(g.spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    merged = f"""aggregate({ordered}, cast(array() AS array<struct<start:int,end:int,kind:string>>),
        (a, s) -> if(size(a) > 0 AND s.start < element_at(a, -1).end,
            concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind))),
            concat(a, array(s))))"""
    text = f"d.`{text_col}`"
    pieces = f"transform(m, (s, i) -> concat(substring({text}, if(i = 0, 0, m[i - 1].end) + 1, s.start - if(i = 0, 0, m[i - 1].end)), '[', upper(s.kind), ']'))"
    clean = f"transform(array({merged}), m -> concat(array_join({pieces}, ''), substring({text}, element_at(m, -1).end + 1)))[0]"
    new = F.when(F.col("g.spans").isNull(), F.col(f"d.`{text_col}`")).otherwise(F.expr(clean))
    return both.select(*(new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in kept))
