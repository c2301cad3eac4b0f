"""Benchmark decontamination by typed templates, in DataFrame operations only.

A text becomes a sequence of template tokens: numbers (digits or words), names (words with a capital and small letters, wherever
they stand, so a name that begins a sentence is one too) and units (after a number) become typed placeholders, and equal
placeholders side by side become one, so "New York" can stand for "Paris"; other words are lower-cased, marks are left out.
Windows of template tokens are hash-joined with the benchmark's, so a question matches its copies with other numbers or names
too. Then the slots of the matched stretch are compared: every value of the benchmark must correspond to one value in the
document (5 -> 7 wherever 5 stands), else the stretch only looks alike.

A document is contaminated by an item if, on one alignment, windows cover at least min_share of the item's windows or
long_run tokens, and at least min_consistent of the slot values correspond. Windows of lower-cased words are joined the same
way, so a word-by-word copy is found whatever its numbers, names and capitals. The benchmark is joined by broadcast only if its
stored windows are below Spark's threshold; beyond it the windows are shuffled. An item shorter than a window is a window
of its own length.

A text's windows come from one expression whose parts are bound by let(), as Spark would put a column's expression into each
place that uses it, and so compute it once for every window.

Cases: null, empty and word-less texts and items match nothing; template windows with fewer than half their tokens literal are no join
keys, but count beside one that is; a very long text is one row of arrays, its time is linear in its words
(and its alignments with an item are one array beside it); equal doc_ids and
repeated rows get the items of all their rows that hold them; a null doc_id is treated as an id; ties don't occur, as all items
of a document are returned; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import ids_and_text, stored, without

TOKEN = r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,:/]\p{N}+)*"
#: Fixed values, by language.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien mil"
).split()
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yard yards mile miles mg g kg gram grams lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh percent degrees dollar dollars cent cents euro euros usd eur "
    "meter kilometer gramm kilogramm sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre grad prozent "
    "mètre mètres kilomètre kilomètres gramme grammes seconde secondes heure heures jour jours semaine semaines mois an ans degrés "
    "metro metros kilómetro kilómetros gramo gramos segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grados"
).split()
NUMBER, NAME, UNIT = "\x01n", "\x01p", "\x01u"
PLACEHOLDERS = f"('{NUMBER}', '{NAME}', '{UNIT}')"


def let(name: str, value: str, body: str) -> str:
    """SQL for body, in which name stands for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def among(x: str, words: list[str]) -> str:
    return f"lower({x}) in (" + ", ".join(f"'{w}'" for w in words) + ")"


def types(tokens: str) -> str:
    """SQL for the template tokens of an array of tokens, before equal placeholders become one."""
    before = f"get({tokens}, i - 1)"
    number_before = f"({before} >= '0' and {before} < ':' or {among(before, NUMBER_WORDS)})"
    return f"""transform({tokens}, (x, i) -> case when x < ':' and x >= '0' or {among("x", NUMBER_WORDS)} then '{NUMBER}'
      when {among("x", UNITS)} and i > 0 and {number_before} then '{UNIT}'
      when x <> lower(x) and x <> upper(x) then '{NAME}'
      else lower(x) end)"""


def begins(typed: str) -> str:
    """SQL for the condition that the k-th token, y, of typed doesn't continue a placeholder (words are beyond '\\x02')."""
    return f"k = 0 or y <> get({typed}, k - 1) or y > '\x02'"


def tokens_of(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN.replace(chr(92), 2 * chr(92))}', 0)"


def template(df: DataFrame) -> DataFrame:
    """df with pairs: array<struct<t: template token, r: its lower-cased words>>, and words: all lower-cased words."""
    starts = f"filter(transform(typed, (y, k) -> if({begins('typed')}, k, -1)), k -> k >= 0)"
    pair = "named_struct('t', get(typed, s), 'r', lower(array_join(slice(tokens, s + 1, coalesce(get(starts, n + 1), size(tokens)) - s), ' ')))"
    pairs = let("typed", types("tokens"), let("starts", starts, f"transform(starts, (s, n) -> {pair})"))
    return df.withColumn("pairs", F.expr(let("tokens", tokens_of("text"), pairs))).withColumn("words", F.expr(f"transform({tokens_of('text')}, x -> lower(x))"))


def windows(codes: str, size: int, salt: int) -> str:
    """SQL for the hashes of the windows of an array of longs, by doubling: a window is two of half its size, which may overlap."""
    if size == 1:
        return f"transform({codes}, x -> xxhash64(x, {salt}))"
    half = 1 << (size - 1).bit_length() - 1
    steps, width, name = [], 1, codes
    while width < half:
        steps.append((f"w{2 * width}", f"transform({name}, (x, i) -> xxhash64(x, get({name}, i + {width})))"))
        width, name = 2 * width, f"w{2 * width}"
    out = f"transform(slice({name}, 1, greatest(0, size({codes}) - {size - 1})), (x, i) -> xxhash64(x, get({name}, i + {size - half}), {salt}))"
    for step, value in reversed(steps):
        out = let(step, value, out)
    return out


TYPED, WORDS = 0, 1  # the salts of the two kinds of windows


def both_windows(text: str, size: int) -> str:
    """SQL for the hashes of the text's typed windows and then those of its words' windows."""
    codes = let("typed", types("tokens"), f"transform(filter(typed, (y, k) -> {begins('typed')}), x -> xxhash64(x))")
    words = "transform(tokens, x -> xxhash64(lower(x)))"
    both = f"concat({let('codes', codes, windows('codes', size, TYPED))}, {let('codes', words, windows('codes', size, WORDS))})"
    return let("tokens", tokens_of(text), both)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, min_share: float = 0.5, long_run: int = 20, min_consistent: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, windows, item_windows, slots, changed (null: word by word)."""
    texts = ids_and_text(docs, id_col, text_col)
    items = template(benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text"))
    items = items.select("item_id", F.explode(F.expr("array(named_struct('exact', false, 'pairs', pairs), named_struct('exact', true, 'pairs', transform(words, w -> named_struct('t', w, 'r', w))))")).alias("s")).select("item_id", "s.*")
    items = items.withColumn("codes", F.expr("transform(pairs, p -> xxhash64(p.t))")).withColumn("width", F.least(F.lit(window), F.size("pairs"))).where("width > 0")
    literal = f"k -> size(filter(slice(pairs, k + 1, width), p -> p.t not in {PLACEHOLDERS})) * 2 >= width"
    items = items.withColumn("keys", F.expr(f"filter(sequence(0, size(pairs) - width), {literal})"))
    items = items.withColumn("item_windows", F.expr("cast(size(pairs) - width + 1 as long)"))
    items = stored(items, "benchmark-templates")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most `window` numbers

    matches = None
    for width in widths:
        own = items.where(F.col("width") == width)
        of_kind = [own.where(F.col("exact") == bool(salt)).select("item_id", "exact", "keys", F.posexplode(F.expr(windows("codes", width, salt))).alias("bpos", "h")) for salt in (TYPED, WORDS)]
        keys = of_kind[0].unionByName(of_kind[1]).where("array_contains(keys, bpos)").drop("keys")
        keys = stored(keys, f"benchmark-windows-{width}")
        hashes = stored(keys.select("h").distinct(), f"benchmark-hashes-{width}")  # the smallest that finds the windows that matter
        every = texts.select("doc_id", F.posexplode(F.expr(both_windows("text", width))).alias("pos", "h"))
        found = every.join(hashes, "h", "left_semi").join(keys, "h").select("doc_id", "item_id", "exact", "bpos", F.expr("pos - bpos").alias("shift"))
        matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        return texts.sparkSession.createDataFrame([], "doc_id long, item_id long, windows long, item_windows long, slots int, changed int")
    aligned = matches.groupBy("doc_id", "item_id", "exact", "shift").agg(F.countDistinct("bpos").alias("windows"))
    aligned = aligned.join(items.select("item_id", "exact", "width", "item_windows", (F.col("item_windows") - F.size("keys")).alias("others")), ["item_id", "exact"])
    enough = "({0} >= item_windows * {1} or {0} + width - 1 >= {2})"
    possible = aligned.where(enough.format("(windows + others)", min_share, long_run))
    hits = stored(possible.select(F.col("doc_id").alias("of"), "item_id", "exact", "shift"), "benchmark-hits")

    ids = hits.select("of").distinct()
    suspects = texts.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    own = stored(template(suspects).select("doc_id", F.col("pairs").alias("typed"), "words"), "suspected-texts")
    # one row per text and item, as a very long text may have as many alignments with an item as words
    of_item = hits.groupBy("of", "item_id", "exact").agg(F.collect_list("shift").alias("shifts"))
    both = own.join(of_item, F.col("doc_id").eqNullSafe(F.col("of"))).join(items.select("item_id", "exact", "pairs", "width", "item_windows"), ["item_id", "exact"])
    # words' windows were numbered after the row's typed ones
    both = both.withColumn("shifts", F.expr("transform(shifts, x -> x - if(exact, greatest(0, size(typed) - width + 1), 0))"))
    same = "forall(sequence(k, k + width - 1), j -> get(pairs, j).t <=> get(own, j + shift).t)"
    stretch = "array_distinct(flatten(transform(covered, k -> sequence(k, k + width - 1))))"
    slot = f"filter({stretch}, j -> get(pairs, j).t in {PLACEHOLDERS})"
    values = f"array_distinct(transform({slot}, j -> named_struct('t', get(pairs, j).t, 'b', get(pairs, j).r, 'd', get(own, j + shift).r)))"
    of_map = "'slots', size(array_distinct(transform(map, m -> named_struct('t', m.t, 'b', m.b)))), 'values', size(map), 'changed', if(exact, null, size(filter(map, m -> not (m.b <=> m.d))))"
    found = let("covered", f"filter(sequence(0, size(pairs) - width), k -> {same})", f"named_struct('windows', cast(size(covered) as long), 'map', {values})")
    found = let("found", found, let("map", "found.map", f"named_struct('windows', found.windows, {of_map})"))
    own_tokens = "if(exact, transform(words, w -> named_struct('t', w, 'r', w)), typed)"
    every_found = let("own", own_tokens, f"transform(shifts, shift -> {found})")
    checked = both.select("doc_id", "item_id", "width", "item_windows", F.explode(F.expr(every_found)).alias("found"))
    checked = stored(checked.select("doc_id", "item_id", "width", "item_windows", "found.*"), "checked-hits")
    checked = checked.where("windows > 0 and " + enough.format("windows", min_share, long_run)).where(F.col("slots") >= F.col("values") * min_consistent)
    return checked.select("doc_id", "item_id", "windows", "item_windows", "slots", "changed")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, item_ids (ascending), n_items, reparameterised (a slot's value differs)."""
    found = contaminated(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.min(F.coalesce("changed", F.lit(0))).alias("changed"))
    out = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("changed") > 0).alias("reparameterised"))
    return out.select("doc_id", "item_ids", F.size("item_ids").cast("long").alias("n_items"), "reparameterised")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with their columns."""
    return without(docs, contaminated_documents(docs, benchmark, **options), "contaminated")
