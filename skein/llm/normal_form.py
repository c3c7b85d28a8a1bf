"""Problem 7: one form for texts that look the same (DuckDB inside Arrow partitions)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.fold import slices
from skein.llm.store import joined, written

# Letters of other alphabets and the Latin letter of the same shape.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "ï", "ј": "j", "ѕ": "s", "ё": "ë", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ї": "Ï", "Ј": "J", "Ѕ": "S", "Ё": "Ë", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ɡ": "g", "ɑ": "a", "օ": "o", "ѵ": "v",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Blocks with compatibility forms that look like their plain form: letterlike symbols, Roman numerals,
#: ligatures, full and half width, mathematical letters.
FORMS = (range(0x2100, 0x2150), range(0x2160, 0x2180), range(0xFB00, 0xFB07), range(0xFF01, 0xFFEF), range(0x1D400, 0x1D800))


def _forms() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms of one character and of several, by the tags of the Unicode database."""
    one, several = {}, {}
    for block in FORMS:
        for cp in block:
            c = chr(cp)
            tag = unicodedata.decomposition(c).split(" ")[0]
            if tag in ("<font>", "<wide>", "<narrow>") or tag == "<compat>" and (0x2160 <= cp < 0x2180 or cp >= 0xFB00):
                plain = unicodedata.normalize("NFKC", c)
                (one if len(plain) == 1 else several)[c] = plain
    return one, several


ONE, SEVERAL = _forms()
SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FE00}-\x{FE0E}\x{FEFF}\x{FFA0}]"
#: A joiner after a pictograph makes one picture of two, so it is visible.
JOINED = r"([\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]\x{FE0F}?)\x{200D}"
#: Stands for a visible joiner while invisible characters are removed.
KEEPER = "\uE000"
#: A text without these is its own normal form but for look-alike letters.
UNUSUAL = r"[\x{AD}\x{2C0}-\x{36F}\x{483}-\x{487}\x{61C}\x{1680}\x{180E}\x{1E00}-\x{1EFF}\x{2000}-\x{200F}\x{202A}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{A0}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2100}-\x{214F}\x{2160}-\x{217F}\x{3099}\x{309A}\x{3164}\x{FB00}-\x{FB06}\x{FE00}-\x{FE0E}\x{FEFF}\x{FF01}-\x{FFEE}\x{1D400}-\x{1D7FF}]"


#: For the intermediate strings of one batch; a single text needs about twelve times its bytes. Nothing spills to disk.
MEMORY = "1GB"
#: Rows of one text that are paired with those of another in one task.
BLOCK = 2000


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def visible_sql(text: str) -> str:
    """SQL for the text in NFC, in plain forms, with plain spaces and without invisible characters."""
    s = f"regexp_replace({text}, {_quoted(JOINED)}, '\\1{KEEPER}', 'g')"
    s = f"regexp_replace({s}, {_quoted(INVISIBLE)}, '', 'g')"
    s = f"regexp_replace({s}, {_quoted(SPACES)}, ' ', 'g')"
    s = f"translate({s}, {_quoted(''.join(ONE) + KEEPER)}, {_quoted(''.join(ONE.values()) + chr(0x200D))})"
    for a, b in SEVERAL.items():
        s = f"replace({s}, {_quoted(a)}, {_quoted(b)})"
    return f"CASE WHEN regexp_matches({text}, {_quoted(UNUSUAL)}) THEN nfc_normalize({s}) ELSE {text} END"


def shape_sql(visible: str) -> str:
    """SQL for the comparison form: look-alike letters as the Latin letter of that shape."""
    return f"nfc_normalize(translate({visible}, {_quoted(''.join(LOOK_ALIKE))}, {_quoted(''.join(LOOK_ALIKE.values()))}))"


def readable_sql(shape: str) -> str:
    """SQL for the output form, a function of the comparison form alone.

    A word is written in Cyrillic if it holds a letter that only Cyrillic has, or if it could be
    Cyrillic and the text has more letters that only Cyrillic has than letters that only Latin has.
    """
    back = {v: k for k, v in reversed(LOOK_ALIKE.items()) if "Ѐ" <= k <= "ӿ" and k not in "һԁԛԝӏӀԚԜҮјѕЈЅ"}
    cyr = f"translate({{}}, {_quoted(''.join(back))}, {_quoted(''.join(back.values()))})"
    only = r"[\x{400}-\x{4FF}]"
    latin = "[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if c not in back) + "]"
    words = f"regexp_extract_all({shape}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    cyrillic = f"length(regexp_replace({shape}, '{only}', '', 'g')) < length(regexp_replace({shape}, '{latin}', '', 'g'))"
    each = f"lambda w: CASE WHEN regexp_matches(w, '{only}') OR ({cyrillic} AND NOT regexp_matches(w, '{latin}')) THEN {cyr.format('w')} ELSE w END"
    # without a letter that only Latin has, every word is or could be Cyrillic
    mixed = f"CASE WHEN regexp_matches({shape}, '{latin}') THEN array_to_string(list_transform({words}, {each}), '') ELSE {cyr.format(shape)} END"
    return f"CASE WHEN regexp_matches({shape}, '{only}') THEN {mixed} ELSE {shape} END"


def embedded(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """``sql`` over each Arrow batch of ``df`` (a key and a text), which it reads as table ``part``.

    Long texts are taken in smaller batches, so that DuckDB stays in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for batch in batches:
            parts = [(0, batch.num_rows)] if batch.nbytes < 16_000_000 else slices(batch.column(1).to_pylist(), 4_000_000)
            for i, j in parts:
                con.register("part", pa.table(batch.slice(i, j - i)))
                out = con.sql(sql).to_arrow_table()
                con.unregister("part")
                yield from out.to_batches()

    return df.mapInArrow(run, schema)


def normal_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id_col`` and ``text_normal``. Null stays null, the empty text stays empty; all texts are read whole."""
    part = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    sql = f"SELECT k, {readable_sql('s')} AS text_normal FROM (SELECT k, {shape_sql('v')} AS s FROM (SELECT k, {visible_sql('t')} AS v FROM part))"
    return embedded(part, sql, "k bigint, text_normal string").withColumnRenamed("k", id_col)


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns form_a, form_b, text_a, text_b, ``id_col``, n_text, n_form: the rows whose text looks like another text.

    Rows are grouped by 128-bit hashes of the comparison form (the class); text_a and text_b are the
    hash of the text itself, whose copies are alike to the letter, n_text their number, and n_form
    the number of rows in the class. A row has n_form - n_text links. Rows with null text are in no
    class; a row that is there twice is two members. A form or text with very many rows is joined
    without a shuffle.
    """
    part = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    sql = f"SELECT k, md5_number_lower(s)::HUGEINT - 9223372036854775808 AS a, md5_number_upper(s)::HUGEINT - 9223372036854775808 AS b, md5_number_lower(t)::HUGEINT - 9223372036854775808 AS x, md5_number_upper(t)::HUGEINT - 9223372036854775808 AS y FROM (SELECT k, t, {shape_sql('v')} AS s FROM (SELECT k, t, {visible_sql('t')} AS v FROM part))"
    sql = f"SELECT k, a::BIGINT AS form_a, b::BIGINT AS form_b, x::BIGINT AS text_a, y::BIGINT AS text_b FROM ({sql})"
    rows, _ = written(embedded(part, sql, "k bigint, form_a bigint, form_b bigint, text_a bigint, text_b bigint"), "shapes")
    form = ["form_a", "form_b"]
    texts = rows.groupBy(*form, "text_a", "text_b").agg(F.count(F.lit(1)).alias("c"))
    several = texts.groupBy(*form).agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("n_form")).filter(F.col("m") > 1)
    texts, _ = written(texts.join(several.drop("m"), form), "texts")
    return joined(rows, texts.withColumn("n_text", F.col("c")), [*form, "text_a", "text_b"], rows.count()).withColumnRenamed("k", id_col)


def look_alikes(df: DataFrame, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Pairs (``id_col``_a < ``id_col``_b) of rows whose texts look the same but are not equal.

    From ``look_alike_classes``: copies of one text are never paired with each other. The rows of a
    text are cut into blocks of about ``block``, and a task pairs a block with a block, so that a
    class with very many rows is many tasks. Rows with one id are in no pair with each other; a row
    that is there twice repeats its pairs.
    """
    form = ["form_a", "form_b"]
    rows, _ = written(look_alike_classes(df, id_col, text_col), "alike")
    blocks = F.ceil(F.col("n_text") / block).cast("int")
    cut = F.pmod(F.xxhash64(id_col), blocks)
    texts = rows.select(*form, "text_a", "text_b", blocks.alias("n")).distinct()
    one, two = (texts.select(*form, F.struct("text_a", "text_b").alias(f"t{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    pairs = one.join(two, form).filter(F.col("t1") < F.col("t2"))
    pairs = pairs.withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    r1, r2 = (rows.select(*form, F.struct("text_a", "text_b").alias(f"t{i}"), cut.cast("int").alias(f"b{i}"), F.col(id_col).alias(f"k{i}")) for i in (1, 2))
    key = [*form, "t1", "b1", "t2", "b2"]
    left = pairs.join(r1, [*form, "t1", "b1"]).select(*key, "k1")
    both = left.join(pairs.join(r2, [*form, "t2", "b2"]).select(*key, "k2"), key).filter(F.col("k1") != F.col("k2"))
    return both.select(F.least("k1", "k2").alias(f"{id_col}_a"), F.greatest("k1", "k2").alias(f"{id_col}_b"))
