"""Blocks: one row for each line of a document, and the decorated view the structure queries run on."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import read_table


def text_to_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, parent, text: a block for each line; a first line '#…' is a header, a last one a footer."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", F.size(lines).alias("n"), F.posexplode(lines).alias("pos", "text"))
    marked = F.col("text").startswith("#")
    parent = (
        F.when(marked & (F.col("pos") == 0), "header").when(marked & (F.col("pos") == F.col("n") - 1), "footer").otherwise("body")
    )
    return rows.select("doc_id", "pos", parent.alias("parent"), "text")


# Where a line stands in a cycle of 24 (h), and the blocks it becomes: base, text, style_level, is_bold. The
# line is always kept whole; structure is written around it.
PIECES = (
    ("h = 0", (("paragraph", "line", "null", False), ("figure", "''", "null", False))),
    ("h = 3", (("paragraph", "line", "null", False), ("table", "''", "null", False))),
    ("h = 6", (("paragraph", "line", "null", False), ("figure", "''", "null", False), ("figure", "''", "null", False))),
    ("h in (1, 7, 8)", (("paragraph", "concat('Figure ', n, ' : ', line)", "null", False),)),
    ("h = 4", (("paragraph", "concat('Tableau ', n, ' : ', line)", "null", False),)),
    ("h = 9", (("paragraph", "concat('1.2. ', line)", "2 + doc_id % 2", False),)),
    ("h = 10", (("paragraph", "concat('CHAPITRE IV ', line)", "null", False),)),
    ("h = 11", (("paragraph", "concat(line, ' voir Figure ', n, '.')", "null", False),)),
    ("h = 12", (("paragraph", "concat('Point ', n)", "null", True), ("paragraph", "line", "null", False))),
    ("h = 15", (("paragraph", "line", "null", False), *[("paragraph", "''", "null", False)] * 3)),
    ("h = 16", (("paragraph", "'SOMMAIRE'", "1", False), ("paragraph", "line", "null", False))),
    ("h between 17 and 20", (("paragraph", "concat(line, TAB, 10 + h)", "2", False),)),
    ("h = 21", (("paragraph", "'CADRE GENERAL'", "null", False), ("paragraph", "line", "null", False))),
    ("h = 22", (("paragraph", "concat(line, ' voir Figure ', n, ' et Tableau ', n, '.')", "null", False),)),
    ("h = 23", (("paragraph", "line", "null", False), ("paragraph", "concat('1.', n, '. Cadre ', n)", "2", False))),
    ("true", (("paragraph", "line", "null", False),)),
)


def pieces(block: str, listed: str, tab: str) -> str:
    """The blocks of a line, as an expression; ``block`` and ``listed`` say how a dialect writes structs and arrays."""
    cases = []
    for when, blocks in PIECES:
        each = (block.format(base=b, text=t.replace("TAB", tab), style=s, bold=str(o).lower()) for b, t, s, o in blocks)
        cases.append(f"when {when} then {listed.format(', '.join(each))}")
    return f"case {' '.join(cases)} end"


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, block_id, base (type of the raw element), text, style_level, is_bold."""
    lines = F.expr(
        "transform(split(coalesce(text, ''), chr(10)), (line, i) -> named_struct('line', line, 'h', (doc_id * 5 + i) % 24, 'n', 1 + (doc_id + i) % 4))"
    )
    block = "named_struct('base', '{base}', 'text', {text}, 'style_level', cast({style} as int), 'is_bold', {bold})"
    inside = pieces(block, "array({})", "chr(9)")
    for name in ("line", "h", "n"):
        inside = re.sub(rf"\b{name}\b(?!')", f"l.{name}", inside)
    rows = read_table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    rows = rows.select("doc_id", F.posexplode(F.expr(f"flatten(transform(lines, l -> {inside}))")).alias("pos", "b"))
    return rows.selectExpr("doc_id", "pos", "concat('b', pos, 'x', doc_id) as block_id", "b.*")


BLOCKS_SQL = f"""select doc_id, pos, 'b' || pos || 'x' || doc_id as block_id, b.base, b.text, b.style_level, b.is_bold
  from (select doc_id, (row_number() over (partition by doc_id order by i, k) - 1)::int as pos, b
    from (select doc_id, i, generate_subscripts(blocks, 1) as k, unnest(blocks) as b
      from (select doc_id, i, {pieces("{{'base': '{base}', 'text': {text}, 'style_level': ({style})::int, 'is_bold': {bold}}}", "[{}]", "chr(9)")} as blocks
        from (select doc_id, i, line, (doc_id * 5 + i) % 24 as h, 1 + (doc_id + i) % 4 as n
          from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as i
            from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))))))"""
