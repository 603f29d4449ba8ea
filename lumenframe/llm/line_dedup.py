"""Line deduplication: an edit-distance join of all distinct lines, in DataFrame operations only.

Lines are cut into EDITS + 1 segments of nearly equal length. If two lines are within EDITS edits, one of the segments
of the shorter occurs in the longer, at a place that the lengths and the number of edits left on either side confine
to a few offsets. Lines of 16 characters and more are cut like the least of a range of lengths, so that a line mostly
looks for the segments of its own and the next shorter lengths at once: the first keeps its place from the start, the
last from the end, those between have a few offsets. Segments are indexed under (least length, number, content), keys are
made once a line and written with it. A line of EDITS characters or fewer has empty segments; it is indexed
under its characters instead, since a longer line within EDITS edits of it keeps one of them. Lines that
meet under a key and are near in length are listed; then letters are counted in them only, and pairs whose numbers of
letters differ by more than the edits allow are passed over. Candidates are stripped of what they share at both ends and verified with a banded bit-parallel edit
distance: a column of the band is one integer of bits, renewed with a few bit operations per character.

A key with more than CROWD indexed lines is crowded. Its lines are dealt to blocks, and pairs are counted and joined inside
a row of two blocks: such a row gives each line its number of links and the least line that it is connected to there,
so that rows grow with lines times blocks and no row stands for a pair. A pair is counted under the least key that it
shares, and only where all of these are crowded; otherwise the join has it.

Lines that are equal are one node from the start. Lines of EDITS characters or fewer are all within EDITS edits of each
other: these links are counted and not listed. Links make classes (connected components); the first line of a class by
doc_id and line number is kept. A line's id is a 64-bit hash, and unique: lines that share one are given others.

Two edits make another word of a short line. So a line of `near_chars` characters and more is kept only if it is the first of its
class, a shorter one if it is the first of those that equal it. This is `kept` of line_classes and what
drop_repeated_lines goes by; classes and links are of lines of all lengths.

Defined cases: null texts count as empty; lines are trimmed of blanks; empty lines are left alone (kept, without a
class); lines and texts of any length are compared whole; null ids come after all others; rows that repeat an id with
another text are documents of their own, those that repeat both id and text are one document; other columns are ignored
(or passed through by drop_repeated_lines, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import connected_components, discard, materialize, unused

EDITS = 2
#: Lines with fewer characters have no class: empty ones.
MIN_CHARS = 1
#: Lines with fewer characters repeat only lines that equal them.
NEAR_CHARS = 20
#: Indexed lines under one key beyond which pairs are counted in blocks, and lines of a block.
CROWD, BLOCK = 128, 128
#: Hashes that meet by chance and are known to the driver at once: 10 ** 12 lines have some 27000 such pairs.
MET = 100_000
#: Candidate lines whose ids are sent to the tasks (8 bytes each); beyond, a bit map of them is, and the join of the lines it marks is by shuffle.
BROADCAST_IDS = 500_000
#: Bits of that map (8 MiB, whatever the number of ids).
BITS = 1 << 26


def _least_length(n: Column, edits: int) -> Column:
    """Least length of the lines that are cut like one of n characters; longer lines are cut alike in wider ranges."""
    width = F.when(n < max(16, 2 * (edits + 1)), 1)
    for least in (32, 64, 128, 256, 512):
        width = width.when(n < least, least // 16)
    return n.bitwiseAND(-width.otherwise(64))


def probe_offsets(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, offset from the segment's own place) of all substrings that a line must probe.

    With i segments in front and edits - i behind, at most i edits lie before a first match and edits - i after a last.
    """
    return [
        (gap, i, shift)
        for gap in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1)
    ]


def _key(line: Column, n: Column, least: Column, i: int, shift: int, edits: int) -> Column:
    """Key of what a line of n characters has, by an offset from its place, for segment i of lines cut like those of `least` characters.

    Segments have one size; the last but one takes what this leaves of `least`, and the last ends the line.
    """
    size = (least / (edits + 1)).cast("int")
    start = n - size + 1 if i == edits else size * i + 1 + shift
    return F.xxhash64(least, F.lit(i), F.substring(line, start, least - size * edits if i == edits - 1 else size))


def _common(a: str, b: str, n: str) -> str:
    """Length of the common prefix of a and b within n characters, by halving steps (SQL)."""
    steps = "array(" + ",".join(str(1 << k) for k in range(20, -1, -1)) + ")"
    return f"aggregate({steps}, 0, (p, k) -> CASE WHEN p + k <= {n} AND substring({a}, p + 1, k) = substring({b}, p + 1, k) THEN p + k ELSE p END)"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a name for value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def banded_distance(a: str, b: str, edits: int) -> str:
    """SQL for the edit distance of columns a and b (from `characters`, a not the shorter), exact up to `edits`.

    Bit k of a column's integers stands for row j - edits + k. The score runs along the band's lower edge until this
    reaches the last row, then along that row; len(a) - len(b) must not exceed `edits`.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    equal = " + ".join(f"CASE WHEN get({a}, j - {edits + 1} + {k}) = c THEN {1 << k} ELSE 0 END" for k in range(width))
    let = _let
    at = f"least({2 * edits}, size({a}) - j + {edits})"  # bit of the row that the score follows
    renewed = (
        "named_struct('vp', (t.hn | ~(shiftright(t.d0, 1) | t.hp)) & {m}L, 'vn', shiftright(t.d0, 1) & t.hp & {m}L,"
        " 's', s.s + CASE WHEN j + {e} <= size({a}) THEN 1 - (shiftright(t.d0, {top}) & 1)"
        " ELSE (shiftright(t.hp, {at}) & 1) - (shiftright(t.hn, {at}) & 1) END)"
    ).format(m=mask, e=edits, a=a, top=2 * edits, at=at)
    horizontal = "named_struct('d0', d, 'hp', (s.vn | ~(d | s.vp)) & {m}L, 'hn', d & s.vp)".format(m=mask)
    diagonal = f"((((e & s.vp) + s.vp) ^ s.vp) | e | s.vn) & {mask}L"
    step = let(f"CAST({equal} AS BIGINT)", "e", let(diagonal, "d", let(horizontal, "t", renewed)))
    # columns are the characters of b; j counts from 1
    begin = f"named_struct('vp', {mask ^ ((1 << edits) - 1)}L & {mask}L, 'vn', 0L, 's', CAST({edits} AS BIGINT))"
    with_c = let(f"get({b}, j - 1)", "c", step)
    return (
        f"aggregate(sequence(1, size({b})), {begin}, (s, j) -> CASE WHEN s.s > {2 * edits + 1} THEN s ELSE {with_c} END, s -> s.s)"
    )


#: Letters whose numbers are compared before a pair becomes a candidate.
COUNTED = "etnaoirshdluc"


def letter_counts(line: Column) -> Column:
    """Numbers of the counted letters in one integer, each modulo 16."""
    count = lambda letter: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
    out = F.lit(0).cast("long")
    for k, letter in enumerate(COUNTED):
        out = out.bitwiseOR(F.shiftleft(count(letter).bitwiseAND(15).cast("long"), 4 * k))
    return out


def near_counts(x: Column, y: Column, edits: int) -> Column:
    """False for lines that are more than `edits` apart: an edit changes two of the numbers by one at most."""
    total = F.lit(0).cast("long")
    for k in range(len(COUNTED)):
        gap = (F.shiftright(x, 4 * k) - F.shiftright(y, 4 * k)).bitwiseAND(15)
        total = total + F.least(gap, 16 - gap)
    return total <= 2 * edits


def near_counts_sql(x: str, y: str, edits: int) -> str:
    """near_counts for SQL expressions inside a lambda."""
    gap = "((shiftright({x}, {k}) - shiftright({y}, {k})) & 15)"
    parts = (f"least({g}, 16 - {g})" for k in range(len(COUNTED)) for g in [gap.format(x=x, y=y, k=4 * k)])
    return f"({' + '.join(parts)}) <= {2 * edits}"


def characters(text: str, edits: int) -> str:
    """SQL for the characters of a text and `edits` marks behind them, so that the band's lower edge starts in range."""
    return f"concat(filter(split({text}, ''), c -> c <> ''), array_repeat('', {edits}))"


def line_distance(x: str, y: str, edits: int) -> str:
    """SQL for the edit distance of two texts, exact up to `edits`, less what they share at both ends; x is not the shorter."""
    inner = banded_distance("cx", "cy", edits)
    for name, text in (("cy", "my"), ("cx", "mx")):
        inner = _let(characters(f"substring({text}, 1, length({text}) - q)", edits), name, inner)
    inner = _let(_common("reverse(mx)", "reverse(my)", "length(my)"), "q", inner)
    for name, text in (("my", y), ("mx", x)):
        inner = _let(f"substring({text}, p + 1)", name, inner)
    return _let(_common(x, y, f"length({y})"), "p", inner)


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """select whose results are computed once a row: a generator keeps them from being copied into later expressions."""
    return df.select(F.inline(F.array(F.struct(*(F.expr(c) for c in columns)))))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no, line): lines between line feeds, trimmed; text_key tells apart different texts of one id."""
    text = whole = F.coalesce(F.col(text_col), F.lit(""))
    for blank in "\t\r":  # searches of bytes, where translate() looks up each character; most texts have neither
        text = F.when(F.contains(text, F.lit(blank)), F.replace(text, F.lit(blank), F.lit(" "))).otherwise(text)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_key"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _index_keys(line: Column, n: Column, edits: int) -> Column:
    """Keys that a line is found under: its segments, or the characters of a line that has fewer characters than segments."""
    segments = F.array(*(_key(line, n, _least_length(n, edits), i, 0, edits) for i in range(edits + 1)))
    return F.when(n > edits, segments).otherwise(_character_keys(line, n))


def _further_keys(line: Column, n: Column, edits: int) -> Column:
    """Keys under which a line of more than `edits` characters looks, beside its own, for lines of its own and the next shorter lengths; some are null.

    Lengths that are cut alike share their keys: an offset of any of them is looked for once.
    """
    keys = []
    for gap in range(edits + 1):
        least = _least_length(n - gap, edits)
        # a segment at the end stays there, whatever the offset
        places = {(i, 0 if i == edits else shift) for further, i, shift in probe_offsets(edits) if further >= gap}
        for i, shift in sorted(places - {(i, 0) for i in range(edits + 1)} if gap == 0 else places):
            key = _key(line, n, least, i, shift, edits)
            keys.append(key if gap == 0 else F.when((least != _least_length(n - gap + 1, edits)) & (n - gap > edits), key))
    keys = F.array(*keys) if keys else F.array().cast("array<bigint>")
    tiny = (F.when(n - m <= edits, _character_keys(line, F.lit(m))).otherwise(F.array().cast("array<bigint>")) for m in range(1, edits + 1))
    return F.when(n > 2 * edits, keys).when(n > edits, F.concat(keys, *tiny)).otherwise(F.array().cast("array<bigint>"))


def _character_keys(line: Column, n: Column) -> Column:
    return F.transform(F.array_distinct(F.filter(F.split(line, ""), lambda c: c != "")), lambda c: F.xxhash64(n, F.lit(-1), c))


def keyed_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Distinct lines (line) with hash, length n, the keys they are found under and the others that they look under."""
    line, n = F.col("line"), F.col("n")
    keyed = lines.select("line", F.xxhash64("line").alias("hash"), F.length("line").alias("n"))
    return keyed.select("line", "hash", "n", _index_keys(line, n, edits).alias("under"), _further_keys(line, n, edits).alias("further"))


def _found_under(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("id").alias("b"), F.col("n").alias("y"), F.explode("under").alias("key"))


def _looking_under(lines: DataFrame, edits: int) -> DataFrame:
    rows = lines.where(F.col("n") > edits).select(F.col("id").alias("a"), F.col("n").alias("x"), F.explode(F.concat("under", "further")).alias("key"))
    return rows.where("key IS NOT NULL")


def _bounded(df: DataFrame) -> DataFrame:
    """A side that is sent to the tasks where its rows, one number each, are few by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _marked(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines whose place in a bit map of all ids is marked: those with one of the ids, and a few others."""
    slot = F.pmod(F.col("id"), F.lit(BITS))
    bucket, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot).cast("int")
    marks = ids.groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))
    byte = "CAST(conv(hex(substring(__bits, __bit DIV 8 + 1, 1)), 16, 10) AS INT)"
    placed = lines.withColumns({"__bucket": bucket, "__bit": bit}).join(F.broadcast(marks), "__bucket")
    return placed.where(f"(shiftright({byte}, __bit % 8) & 1) = 1").select(lines.columns)


def _lines_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines with one of these ids, which are distinct."""
    if ids.count() <= BROADCAST_IDS:
        return lines.join(F.broadcast(ids), "id")
    return _marked(lines, ids).join(ids, "id")


def similar_lines(lines: DataFrame, edits: int = EDITS, crowded: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) for each pair of distinct lines (id, and columns of keyed_lines) within `edits` edits; a has no fewer characters.

    Pairs in which neither line has more than `edits` characters are all within `edits` edits and not listed, nor are
    those that share crowded keys only.
    """
    index, probes = _found_under(lines), _looking_under(lines, edits)
    if crowded is not None:
        index = index.join(_bounded(crowded.select("key")), "key", "left_anti")
    # few lines share a key: the index is hashed, and letters are counted only in lines that have met another
    met = probes.join(index.hint("shuffle_hash"), "key").where(F.expr(f"x - y BETWEEN 0 AND {edits} AND (x > y OR a < b)"))
    met = materialize(met.select("a", "b").distinct(), "line-pairs")
    ids = materialize(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-ids")
    texts = materialize(_lines_of(lines.select("id", "line"), ids).withColumn("counts", letter_counts(F.col("line"))), "line-texts")
    counts = texts.select("id", "counts")
    near = met.join(counts.toDF("a", "x"), "a").join(counts.toDF("b", "y"), "b").where(near_counts(F.col("x"), F.col("y"), edits))
    candidates = materialize(near.select("a", "b"), "line-candidates")
    both = candidates.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    both = _once(both, "a", "b", "x", "y", f"{_common('x', 'y', 'length(y)')} AS p")
    both = _once(both, "a", "b", "substring(x, p + 1) AS x", "substring(y, p + 1) AS y", "reverse(substring(x, p + 1)) AS rx", "reverse(substring(y, p + 1)) AS ry")
    both = _once(both, "a", "b", "x", "y", f"{_common('rx', 'ry', 'length(y)')} AS q")
    both = _once(both, "a", "b", *(f"{characters(f'substring({c}, 1, length({c}) - q)', edits)} AS {c}" for c in "xy"))
    links = materialize(both.select("a", "b", F.expr(banded_distance("x", "y", edits)).cast("int").alias("distance")).where(F.col("distance") <= edits), "line-links")
    discard(met, ids, texts, candidates)
    return links


def crowded_keys(lines: DataFrame) -> DataFrame:
    """(key, held): keys under which more than CROWD lines are found."""
    return materialize(_found_under(lines).groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > CROWD), "crowded-keys")


def crowded_links(lines: DataFrame, crowded: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, n, low): of the links that similar_lines leaves to crowded keys, those that a line has within two blocks, and the least line they connect it to."""
    keys = _bounded(crowded.select("key"))
    held = materialize(_found_under(lines).join(keys, "key", "left_semi").select("key", F.col("b").alias("id")), "crowded-held")
    asking = materialize(_looking_under(lines, edits).join(keys, "key", "left_semi").select("key", F.col("a").alias("id")).distinct(), "crowded-asking")
    own = asking.groupBy("id").agg(F.collect_set("key").alias("hot"))  # at most one for each probe of a line
    ids = materialize(held.select("id").unionByName(asking.select("id")).distinct(), "crowded-ids")
    facts = _lines_of(lines, ids).join(own, "id", "left")
    probes = F.filter(F.concat("under", "further"), lambda k: k.isNotNull())
    hot = F.coalesce("hot", F.array().cast("array<bigint>"))
    facts = facts.select("id", F.struct("id", "line", "n", letter_counts(F.col("line")).alias("counts"), hot.alias("hot"), F.array_except(probes, hot).alias("cold"), "under").alias("member"))
    facts = materialize(facts, "crowded-lines")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        counts = materialize(rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "crowded-blocks")
        dealt = rows.join(_bounded(counts), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), "blocks"))
        return dealt.join(facts, "id").groupBy("key", "block").agg(F.collect_list("member").alias(name)).drop("block")

    both = blocks(asking, "xs").join(blocks(held, "ys"), "key")
    linked = (
        f"x.id <> y.id AND (x.n > y.n OR (x.n = y.n AND x.id < y.id)) AND x.n - y.n <= {edits} AND {near_counts_sql('x.counts', 'y.counts', edits)}"
        " AND key = array_min(array_intersect(x.hot, y.under)) AND NOT arrays_overlap(x.cold, y.under)"
        f" AND {line_distance('x.line', 'y.line', edits)} <= {edits}"
    )
    both = _once(both, f"filter(transform(xs, x -> struct(x.id AS id, transform(filter(ys, y -> {linked}), y -> y.id) AS near)), r -> size(r.near) > 0) AS links")
    # groups of lines that are connected within the two blocks
    group = "concat(array(r.id), r.near)"
    join = f"concat(filter(g, s -> NOT arrays_overlap(s, {group})), array(array_distinct(flatten(concat(filter(g, s -> arrays_overlap(s, {group})), array({group}))))))"
    both = _once(both.where("size(links) > 0"), "links", f"aggregate(links, CAST(array() AS array<array<bigint>>), (g, r) -> {join}) AS parts", "flatten(transform(links, r -> r.near)) AS ends")
    rows = both.select("links", "ends", F.explode("parts").alias("part")).select("links", "ends", F.array_min("part").alias("low"), F.explode("part").alias("id"))
    count = "CAST(coalesce(get(filter(links, r -> r.id = id), 0).near, array()) AS array<bigint>)"
    out = materialize(rows.select("id", F.expr(f"CAST(size({count}) + size(filter(ends, e -> e = id)) AS BIGINT)").alias("n"), "low"), "crowded-links")
    discard(held, asking, ids, facts)
    return out


def _distinct_ids(distinct: DataFrame, hashed: Column | None = None) -> Column:
    """The id of a line, unique among these lines: those whose hashes (column `hashed` if known) meet are hashed again with a number."""
    line, salt = F.col("line"), 0
    out = F.xxhash64(line) if hashed is None else hashed
    while met := [r["id"] for r in distinct.select(out.alias("id")).groupBy("id").count().where("count > 1").limit(MET + 1).collect()]:
        if len(met) > MET:
            raise RuntimeError("line hashes meet far more often than by chance")
        salt += 1
        out = F.when(out.isin(met), F.xxhash64(line, F.lit(salt))).otherwise(out)
    return out


def _placed_lines(docs: DataFrame, edits: int, min_chars: int, near_chars: int, id_col: str, text_col: str) -> DataFrame:
    """line_classes, and with each line its text_key."""
    lines = line_rows(docs, id_col, text_col)
    long = F.length("line") >= min_chars
    distinct = materialize(keyed_lines(lines.where(long).select("line").distinct(), edits), "lines")
    line_id = _distinct_ids(distinct, F.col("hash"))
    nodes = distinct.select(line_id.alias("id"), "line", "n", "under", "further")
    placed = materialize(lines.withColumn("hash", F.xxhash64("line")).select("doc_id", "text_key", "line_no", F.when(long, line_id).alias("id"), (F.length("line") < near_chars).alias("short")), "line-places")
    crowded = crowded_keys(nodes)
    links = similar_lines(nodes, edits, crowded)
    within = crowded_links(nodes, crowded, edits)
    # lines of `edits` characters or fewer are one class: each is tied to the least of them, and counts all others as links
    tiny = materialize(nodes.where(F.col("n") <= edits).select("id"), "tiny-lines")
    least = tiny.agg(F.min("id").alias("b"), F.count("*").alias("n_tiny"))
    ties = tiny.select(F.col("id").alias("a")).crossJoin(F.broadcast(least))  # with one row
    one = F.lit(1).cast("long").alias("n")
    ends = links.select(F.col("a").alias("id"), one).unionByName(links.select(F.col("b").alias("id"), one))
    ends = ends.unionByName(within.select("id", "n")).unionByName(ties.select(F.col("a").alias("id"), (F.col("n_tiny") - 1).alias("n")))
    ends = ends.groupBy("id").agg(F.sum("n").alias("n_links"))
    component = connected_components(links.select("a", "b").unionByName(within.select(F.col("id").alias("a"), F.col("low").alias("b"))).unionByName(ties.select("a", "b"))).withColumnRenamed("node", "id")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "line_no")
    with_id = placed.where("id IS NOT NULL")
    known = with_id.groupBy("id").agg(F.count("*").alias("n"), F.min(place).alias("low")).join(component, "id", "left").join(ends, "id", "left")
    known = materialize(known.select("id", "n", F.col("low").alias("own"), F.col("component").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-nodes")
    # most lines are alone in their class
    alone = known.where("class_id IS NULL").select("id", "own", F.col("id").alias("class_id"), "n_links", F.col("n").alias("class_size"), F.col("own").alias("low"))
    tied = known.where("class_id IS NOT NULL")
    classes = tied.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.min("own").alias("low"))
    known = alone.unionByName(tied.select("id", "own", "class_id", "n_links").join(classes, "class_id"))
    discard(distinct, crowded, links, within, tiny, component)
    with_class = with_id.join(known, "id").select(
        "doc_id", "text_key", "line_no", F.col("id").alias("line_id"), "class_id", "class_size", "n_links",
        (place == F.when(F.col("short"), F.col("own")).otherwise(F.col("low"))).alias("kept"),
    )
    nothing = F.lit(None).cast("long")
    rest = placed.where("id IS NULL").select(
        "doc_id", "text_key", "line_no", nothing.alias("line_id"), nothing.alias("class_id"), nothing.alias("class_size"), nothing.alias("n_links"), F.lit(True).alias("kept")
    )
    return with_class.unionByName(rest)


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, line_no, line_id, class_id, class_size, n_links, kept."""
    return _placed_lines(docs, edits, min_chars, near_chars, id_col, text_col).drop("text_key")


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs without the lines that line_classes does not keep. Columns and rows stay; n_chars, where present, follows."""
    id_, key, cut = unused(docs, "id", "key", "gone")
    gone = _placed_lines(docs, edits, min_chars, near_chars, "doc_id", "text").where("not kept").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.collect_set("line_no").alias(cut))
    gone = materialize(gone, "lines-gone")
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[key]), "left")
    kept = F.array_join(F.filter(F.split(docs["text"], "\n", -1), lambda line, k: ~F.array_contains(F.col(cut), k)), "\n")
    out = joined.withColumn("text", F.when(F.col(cut).isNull(), docs["text"]).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
