"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import bucket_components, shared_buckets
from tidemark.llm.shared import bit_filter, kept_table, maybe_in

# Letter groups counted per line; an edit changes at most two counts by one each.
_COMPARED = 16
_GROUPS = ("eéèE", "tT", "nñN", "hH", "aäáA", "iíI", "oóöO", "sS", "rR", "dlu")


def segment_keys(line: str, n: str, edits: int) -> Column:
    """Keys of a line: its own segments and the substrings that may equal a shorter partner's.

    A line of l characters is split into `edits` + 1 segments, the last l mod (edits + 1)
    of them a character longer. For every partner length from l - `edits` to l and every
    segment, the key holds the substrings whose place fits both the edits spent before the
    segment and those left after it; equal (segment, start, length) count once. Lines of at
    most `edits` characters have no keys: one of their segments would be empty.
    """
    parts = edits + 1
    spans: list[str] = []
    for less in range(parts):
        for i in range(parts):
            partner = f"({n} - {less})"
            short = f"cast({partner} div {parts} as int)"
            longer = f"cast({partner} % {parts} as int)"
            size = f"({short} + if({i} >= {parts} - {longer}, 1, 0))"
            start = f"({i} * {short} + greatest(0, {i} - ({parts} - {longer})))"
            for shift in range(max(-i, less - (parts - 1 - i)), min(i, less + (parts - 1 - i)) + 1):
                spans.append(f"named_struct('i', {i}, 's', {start} + {shift}, 'n', {size})")
    distinct = f"array_distinct(array({', '.join(spans)}))"
    key = f"x -> xxhash64(x.i, x.n, substring({line}, x.s + 1, x.n))"
    keys = f"array_distinct(transform(filter({distinct}, x -> x.s >= 0 and x.n > 0 and x.s + x.n <= {n}), {key}))"
    return F.expr(f"if({n} > {edits}, {keys}, cast(array() as array<bigint>))")


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether two strings have an edit distance of at most `edits`.

    Myers' bit vectors over a band of 2 * `edits` + 1 diagonals: bit i stands for pattern
    row j - `edits` + i in column j. The distance is followed down the lowest diagonal of
    the band while it is inside the pattern, then along the pattern's last row. Columns
    after the distance went beyond reach are skipped.
    """
    width, mask = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    match = " + ".join(f"if(coalesce(get(q.p, j - 1 - {edits} + {i}) = q.t[j - 1], false), {1 << i}L, 0L)" for i in range(width))
    d0 = f"(((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {mask}L)"
    hp, hn = f"((s.vn | ~({d0} | s.vp)) & {mask}L)", f"({d0} & s.vp)"
    row = f"(size(q.p) - s.j + {edits})"
    # At most 2 * edits + (columns - rows) steps along the last row can win something back.
    step = f"""
      if(s.d > {2 * edits} + size(q.t) - size(q.p), s, named_struct(
        'vp', ({hn} | ~(shiftright({d0}, 1) | {hp})) & {mask}L,
        'vn', shiftright({d0}, 1) & {hp},
        'd', s.d + if(s.j + {edits} <= size(q.p),
                      if({d0} & {1 << (width - 1)}L = 0, 1, 0),
                      cast(shiftright({hp}, {row}) & 1 as int) - cast(shiftright({hn}, {row}) & 1 as int)),
        'j', s.j + 1))
    """
    start = f"named_struct('vp', {mask & ~((1 << edits) - 1)}L, 'vn', 0L, 'd', {edits}, 'j', 1)"
    columns = f"transform(sequence(1, size(q.t)), j -> {match})"
    distance = f"transform(array(named_struct('p', split(x.a, ''), 't', split(x.b, ''))), q -> aggregate({columns}, {start}, (s, m) -> {step}, s -> s.d))[0]"

    # What both ends have in common is cut off by whole blocks; `edits` + 1 characters stay.
    def common(one: str, two: str, room: str) -> str:
        block = f"k -> substring({one}, k * {_COMPARED} + 1, {_COMPARED}) != substring({two}, k * {_COMPARED} + 1, {_COMPARED})"
        return f"{_COMPARED} * coalesce(nullif(array_position(transform(sequence(0, greatest(0, {room})), {block}), true), 0) - 1, greatest(0, {room}))"

    room = f"cast((least(length({a}), length({b})) - {edits + 1}) div {_COMPARED} as int) - 1"
    left = f"transform(array(cast({common(a, b, room)} as int)), c -> named_struct('a', substring({a}, c + 1), 'b', substring({b}, c + 1)))[0]"
    room = f"cast((least(length(y.a), length(y.b)) - {edits + 1}) div {_COMPARED} as int) - 1"
    both = f"transform(array({left}), y -> transform(array(cast({common('reverse(y.a)', 'reverse(y.b)', room)} as int)), c -> named_struct('a', substring(y.a, 1, length(y.a) - c), 'b', substring(y.b, 1, length(y.b) - c)))[0])[0]"
    return F.expr(
        f"{a} = {b} or (abs(length({a}) - length({b})) <= {edits} and least(length({a}), length({b})) > {edits}"
        f" and transform(array({both}), x -> {distance})[0] <= {edits})"
    )


def _occurrences(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    lines = rows.select("doc_id", F.xxhash64("_text").alias("_t"), F.posexplode(F.split("_text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("n_chars", F.length("line")).where((F.col("n_chars") >= min_chars) & F.col("line").rlike(r"\S"))
    return lines.select("doc_id", "_t", "line_no", "n_chars", F.xxhash64("line").alias("_h1"), F.xxhash64(F.lit(1), "line").alias("_h2"), "line")


def near_lines(docs: DataFrame, edits: int = 2, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of lines that `edits` single-character edits link, over all documents.

    A row per line of at least `min_chars` characters that is not blank (1 takes them all,
    as the query and the pipeline do): doc_id, line_no (from 0), n_chars, class_doc and
    class_line (the first line of the class, by doc_id then line_no), kept (it is that line),
    near (its text differs from that line's), and `_t`, a key of the document's text. Lines of
    at most `edits` characters, of which any two are that near, are linked by equality only.

    Lines end at line feeds. Equal lines are one node. A node's segment keys are its
    buckets (`segment_keys`), and `bucket_components` confirms pairs by `within_edits`; counts of
    letter groups rule out most pairs before. Texts are shuffled for candidates only.

    Null and empty texts have no lines; rows without an id come last in the order of a
    class; rows equal in id and text are one document, whose lines have the same result in
    each row; an empty table gives no rows; other columns are ignored.
    """
    if min_chars < 1:
        raise ValueError("min_chars has to be 1 or more")
    occ = _occurrences(docs, min_chars, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_t", "line_no")
    keyed = occ.select("_h1", "_h2", "n_chars", place.alias("_at"), segment_keys("line", "n_chars", edits).alias("_keys"))
    unique = keyed.groupBy("_h1", "_h2").agg(F.min("_at").alias("_at"), F.first("_keys").alias("_keys"))
    nodes = kept_table(unique.withColumn("node", F.monotonically_increasing_id()))

    entries = kept_table(shared_buckets(nodes.select("node", F.explode("_keys").alias("bucket"))))
    wanted = kept_table(entries.select("node").distinct().join(nodes.select("node", "_h1", "_h2", "_at"), "node"))
    wants = wanted.select("node", F.col("_h1").alias("_w1"), F.col("_h2").alias("_w2"), *[F.col(f"_at.{c}").alias(f"_w_{c}") for c in ("doc_id", "_t", "line_no")])
    same = (
        (F.col("_h1") == F.col("_w1")) & (F.col("_h2") == F.col("_w2")) & F.col("doc_id").eqNullSafe(F.col("_w_doc_id"))
        & (F.col("_t") == F.col("_w__t")) & (F.col("line_no") == F.col("_w_line_no"))
    )
    found = maybe_in(occ, "_h1", bit_filter(wanted, "_h1")).join(wants, same)
    counts = [(F.col("n_chars") - F.length(F.translate("line", g, ""))).alias(f"g{i}") for i, g in enumerate(_GROUPS)]
    texts = kept_table(found.select("node", "line", F.col("n_chars").alias("n"), *counts))

    marks = ["n", *[f"g{i}" for i in range(len(_GROUPS))]]
    marked = kept_table(entries.join(texts.select("node", *marks).distinct(), "node"))
    apart = " + ".join(f"abs({m} - other_{m})" for m in marks[1:])
    close = f"abs(n - other_n) <= {edits} and {apart} <= {2 * edits}"

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("_la"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("_lb"))
        return pairs.join(left, "a").join(right, "b").where(within_edits("_la", "_lb", edits)).select("a", "b")

    roots = bucket_components(marked, marks, close, confirmed)
    placed = kept_table(nodes.select("node", "_h1", "_h2", "_at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = placed.groupBy("root").agg(F.min("_at").alias("_best"))
    classes = placed.join(best, "root").select(F.col("_h1").alias("_c1"), F.col("_h2").alias("_c2"), (F.col("_at") != F.col("_best")).alias("near"), "_best")
    out = occ.drop("line").join(classes, (F.col("_h1") == F.col("_c1")) & (F.col("_h2") == F.col("_c2")))
    first = F.col("_best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_best._t") == F.col("_t")) & (F.col("_best.line_no") == F.col("line_no"))
    return out.select(
        "doc_id", "line_no", "n_chars", F.col("_best.doc_id").alias("class_doc"), F.col("_best.line_no").alias("class_line"),
        first.alias("kept"), "near", "_t",
    )


def without_repeats(docs: DataFrame, edits: int = 2, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the lines that an earlier line of their class repeats, columns unchanged.

    A column `n_chars` is brought up to date. Documents that lose all their lines that are
    not blank are dropped; documents that lose nothing pass unchanged, null texts included.
    """
    gone = near_lines(docs, edits, min_chars, id_col, text_col).where("not kept")
    # Rows equal in id and text have the same lines: a set, so each counts once.
    lost = gone.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_dt")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    rows = rows.join(lost, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_dt")), "left")
    rest = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    rows = rows.withColumn("_new", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rest))
    rows = rows.where(F.col("_gone").isNull() | F.col("_new").rlike(r"\S"))
    made = {text_col: F.col("_new"), "n_chars": F.length("_new").cast("long")}
    columns = [(made[c] if c in made else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    return rows.select(*columns)
