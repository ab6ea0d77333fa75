"""From page boxes and Markdown to blocks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.headings import INHERITED, heading_type
from vellum.functions.text import box_text, clean_heading, count_tokens, join_segments, looks_like_metadata, normalize, starts_with_lowercase, strip

#: Pages of a document that are walked together.
PAGE_BLOCK = 4096
#: Breaks of lines besides the line feed.
LINE_BREAKS = "\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"


def layout_clean(raw: Column, boxes: Column, *, index: str = "box_index", kind: str = "box_class", span: str = "char_span") -> Column:
    """[TXT4] ``struct(body, captions)`` of a page from its layout boxes.

    Boxes in order of their index; pictures, page headers and footers are
    dropped, captions go aside, the rest is joined. Without boxes, or if
    less than 50 characters come out of more than 200, the body is the raw text. Null text gives ''.
    """
    text = F.coalesce(raw, F.lit(""))
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b[index].alias("i"), b[kind].alias("k"), b[span].alias("s"))))
    slices = F.filter(F.transform(ordered, lambda b: F.struct(b["k"].alias("k"), box_text(text, b["s"]).alias("t"))), lambda b: (b["t"] != "") & ~F.coalesce(b["k"], F.lit("")).isin("picture", "page-header", "page-footer"))
    captions = F.coalesce(F.transform(F.filter(slices, lambda b: F.coalesce(b["k"] == "caption", F.lit(False))), lambda b: b["t"]), F.array().cast("array<string>"))
    body = join_segments(F.transform(F.filter(slices, lambda b: F.coalesce(b["k"] != "caption", F.lit(True))), lambda b: b["t"]))
    bare = F.coalesce(F.size(boxes), F.lit(0)) <= 0
    poor = (F.length(body) < 50) & (F.length(strip(text)) > 200)
    return F.struct(F.when(bare | poor, strip(text)).otherwise(body).alias("body"), captions.alias("captions"))


def markdown_units(text: Column) -> Column:
    """[GEN1] Array of ``struct(kind, text, level)``: headings and paragraphs of a Markdown text in order.

    Headings are set apart first, then the text is cut at blank lines and the
    lines of each paragraph are joined by a space. Null or blank text gives an empty array.
    """
    x = F.translate(normalize(text), LINE_BREAKS, "\n" * len(LINE_BREAKS))
    marked = F.regexp_replace(x, r"(?m)^[ ]*(#{1,6})[ ]+(\S.*?)[ ]*$", "\n\n\x01$1 $2\n\n")
    parts = F.transform(F.split(marked, r"\n[ ]*\n\s*"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    units = F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.when(
            p.startswith("\x01"),
            F.struct(F.lit("heading").alias("kind"), clean_heading(F.regexp_extract(p, "^\x01#+ (.*)$", 1)).alias("text"), F.length(F.regexp_extract(p, "^\x01(#+) ", 1)).alias("level")),
        ).otherwise(F.struct(F.lit("paragraph").alias("kind"), p.alias("text"), F.lit(None).cast("int").alias("level"))),
    )
    return F.filter(units, lambda u: u["text"] != "")


def document_blocks(pages: DataFrame) -> DataFrame:
    """[GEN2, GEN3, FIL6] Blocks of documents, with the section and type they stand in.

    ``pages``: ``document_id, title, page_order, page_number, text, captions``. Out come
    ``document_id, page_order, pos, text, page_number, section, chunk_type, is_heading, level``;
    ``pos`` counts blocks of a page from 0, captions last. The section carries over
    pages; a heading that names no section takes the type of the nearest open heading above it that can be inherited.
    A page of which half the paragraphs, and two at least, are publisher's
    matter is metadata as a whole. Null and blank pages give nothing; a page must occur once.
    """
    base = pages.select("document_id", "title", "page_order", "page_number", "captions", markdown_units(F.col("text")).alias("units"))
    units = base.select("document_id", "title", "page_order", "page_number", F.posexplode("units").alias("pos", "u")).select("*", "u.kind", "u.text", "u.level").drop("u")
    paragraph = F.col("kind") == "paragraph"
    here = F.struct("page_order", "pos", "level", "text", F.when(~paragraph, heading_type(F.col("text"))).alias("direct"))
    units = units.withColumns({"block": F.floor(F.col("page_order") / PAGE_BLOCK), "heading": F.when(~paragraph, here)})

    # the last heading of each level in the blocks before: a row a block of pages
    earlier = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 7)
    lasts = units.groupBy("document_id", "block").agg(*[F.max(F.when(F.col("level") == n, F.col("heading"))).alias(f"m{n}") for n in levels])
    carried = lasts.select("document_id", "block", *[F.last(f"m{n}", ignorenulls=True).over(earlier).alias(f"c{n}") for n in levels])

    # all windows below share one partitioning and, but for the page's, one order
    of_block = Window.partitionBy("document_id", "block").orderBy("page_order", "pos")
    before, upto = of_block.rowsBetween(Window.unboundedPreceding, -1), of_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = units.join(carried, ["document_id", "block"], "left")
    rows = rows.withColumns({f"l{n}": F.coalesce(F.last(F.when(F.col("level") == n, F.col("heading")), ignorenulls=True).over(before), F.col(f"c{n}")) for n in levels})

    def at(h: Column) -> Column:
        return F.struct(h["page_order"], h["pos"])

    def kind_under(h: Column, above: str) -> Column:
        """The type of heading ``h`` when the last headings of each level are ``above``1 to 6; those a higher one has closed don't count."""
        kind = F.when(h["direct"] != "body", h["direct"])
        for n in reversed(levels):
            x, open_ = F.col(f"{above}{n}"), F.lit(True)
            for m in range(1, n):
                open_ = open_ & F.coalesce(at(F.col(f"{above}{m}")) < at(x), F.lit(True))
            kind = F.coalesce(kind, F.when((h["level"] > n) & open_ & x["direct"].isin(*INHERITED), x["direct"]))
        return F.when(h.isNotNull(), F.struct(h["text"].alias("text"), F.coalesce(kind, F.lit("body")).alias("kind_of_heading")))

    rows = rows.withColumn("own", kind_under(F.col("heading"), "l"))
    # the heading that the block begins under is the last of those carried
    start = F.greatest(*[F.col(f"c{n}") for n in levels])
    rows = rows.withColumn("current", F.coalesce(F.last("own", ignorenulls=True).over(upto), kind_under(start, "c")))
    rows = rows.withColumn("meta", paragraph & looks_like_metadata(F.col("text")))
    page = Window.partitionBy("document_id", "block", "page_order")
    hits, n = F.count_if("meta").over(page), F.count_if(paragraph).over(page)
    mostly = hits >= F.greatest(F.lit(2), F.floor(n / 2))
    section = F.coalesce(F.col("current.text"), F.when(F.trim("title") != "", F.col("title")), F.lit("Main text"))
    body = rows.select(
        "document_id",
        "page_order",
        "pos",
        "text",
        "page_number",
        section.alias("section"),
        F.when(paragraph & (mostly | F.col("meta")), "metadata").otherwise(F.coalesce("current.kind_of_heading", F.lit("body"))).alias("chunk_type"),
        (~paragraph).alias("is_heading"),
        "level",
    )
    caption = base.select("document_id", "page_order", "page_number", F.posexplode("captions").alias("i", "c")).withColumn("c", normalize(F.col("c"))).where("c <> ''")
    captions = caption.select(
        "document_id",
        "page_order",
        (F.col("i") + (1 << 20)).alias("pos"),
        F.col("c").alias("text"),
        "page_number",
        F.lit("Figure / Table Caption").alias("section"),
        F.lit("caption").alias("chunk_type"),
        F.lit(False).alias("is_heading"),
        F.lit(None).cast("int").alias("level"),
    )
    return body.unionByName(captions)


def repair_interrupted(blocks: DataFrame, most_tokens: int = 250) -> DataFrame:
    """[GEN5] Paragraphs that a side box interrupts within a word are joined again.

    Of four blocks of one page, a paragraph ending in a hyphen, a heading, a
    paragraph of at most ``most_tokens`` tokens and one that begins in lower case, the first and
    last become one, the middle two a block of type 'sidebar'. Blocks that follow on
    the page, up to the next heading, get back the section and type from before. Of
    overlapping cases the earlier is taken.
    """
    order = Window.partitionBy("document_id", "page_order").orderBy("pos")
    x = blocks.withColumn("n", F.row_number().over(order))

    def ahead(c: str, k: int) -> Column:
        return F.lead(c, k).over(order)

    case = (
        ~F.col("is_heading")
        & F.rtrim("text").endswith("-")
        & F.coalesce(ahead("is_heading", 1), F.lit(False))
        & ~F.coalesce(ahead("is_heading", 2), F.lit(True))
        & ~F.coalesce(ahead("is_heading", 3), F.lit(True))
        & starts_with_lowercase(ahead("text", 3))
        & (count_tokens(ahead("text", 2)) <= most_tokens)
    )
    x = x.withColumns({"case": case, "next_text": ahead("text", 1), "box_text": ahead("text", 2), "rest": ahead("text", 3), "box_section": ahead("section", 1)})
    # cases three blocks apart share a block; of such a chain every second one holds
    third = Window.partitionBy("document_id", "page_order", "case", F.col("n") % 3).orderBy("n")
    x = x.withColumn("chain", F.col("n") - 3 * F.row_number().over(third))
    link = Window.partitionBy("document_id", "page_order", "case", F.col("n") % 3, "chain").orderBy("n")
    x = x.withColumn("take", F.col("case") & (F.row_number().over(link) % 2 == 1))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"last": F.last(F.when(F.col("take"), F.struct("n", "section", "chunk_type", "box_section")), ignorenulls=True).over(upto), "head": F.last(F.when(F.col("is_heading"), F.col("n")), ignorenulls=True).over(upto)})
    since = F.col("n") - F.col("last.n")
    back = (since > 3) & (F.col("head") == F.col("last.n") + 1) & (F.col("section") == F.col("last.box_section"))
    back = F.coalesce(back, F.lit(False))
    merged = F.concat(F.regexp_replace(F.rtrim("text"), "-$", ""), F.ltrim("rest"))
    kept = x.where(F.coalesce(~since.isin(2, 3), F.lit(True)))
    side = F.coalesce(since == 1, F.lit(False))
    return kept.select(
        "document_id",
        "page_order",
        "pos",
        F.when(F.col("take"), merged).when(side, F.concat("text", F.lit("\n\n"), "next_text")).otherwise(F.col("text")).alias("text"),
        "page_number",
        F.when(back, F.col("last.section")).otherwise(F.col("section")).alias("section"),
        F.when(side, "sidebar").when(back, F.col("last.chunk_type")).otherwise(F.col("chunk_type")).alias("chunk_type"),
        F.when(side, False).otherwise(F.col("is_heading")).alias("is_heading"),
        F.when(side, F.lit(None).cast("int")).otherwise(F.col("level")).alias("level"),
    )
