"""Profiles of Office, OpenDocument and EPUB packages from their member rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import count_matches, match_values, xml_value
from tablemill.operators.formats import utf8

# Members whose text is read. Fixed names first, then patterns.
MEMBERS = [
    r"word/(?:document|comments|footnotes|endnotes|fontTable)\.xml", r"docProps/core\.xml", r"mimetype",
    r"content\.xml", r"styles\.xml", r"meta\.xml", r"META-INF/container\.xml", r"(?i:ppt/slides/slide\d+\.xml)",
    r".*\.opf", r".*\.rels",
]

# Counters per family. counter: (member name pattern, pattern in its text or None to count the members)
FAMILIES: dict[str, dict[str, list[tuple[str, str | None]]]] = {
    "writer": {
        "paragraphs": [(r"^word/document\.xml$", r"<w:p(?:\s|>)")],
        "headings": [(r"^word/document\.xml$", r"""<w:pStyle\b[^>]*w:val=["'](?:Heading|heading)[^"']*["']""")],
        "tables": [(r"^word/document\.xml$", r"<w:tbl(?:\s|>)")],
        "images": [(r"^word/media/.*[^/]$", None)],
        "comments": [(r"^word/comments\.xml$", r"<w:comment(?:\s|>)")],
        "tracked_changes": [(r"^word/document\.xml$", r"<w:(?:ins|del|moveFrom|moveTo)(?:\s|>)")],
        "footnotes": [(r"^word/footnotes\.xml$", r"<w:footnote(?:\s|>)")],
        "endnotes": [(r"^word/endnotes\.xml$", r"<w:endnote(?:\s|>)")],
        "equations": [(r"^word/document\.xml$", r"<m:oMath(?:Para)?(?:\s|>)")],
        "sections": [(r"^word/document\.xml$", r"<w:sectPr(?:\s|>)")],
        "embedded_objects": [(r"^word/embeddings/.*[^/]$", None)],
        "macro_parts": [(r"(?i)word/vbaProject\.bin$", None)],
    },
    "presentation": {
        "slides": [(r"(?i)^ppt/slides/slide\d+\.xml$", None)],
        "paragraphs": [(r"(?i)^ppt/slides/slide\d+\.xml$", r"<a:p(?:\s|>)")],
        "images": [(r"^ppt/media/.*[^/]$", None)],
        "comments": [(r"(?i)^ppt/comments/comment\d+\.xml$", None)],
        "speaker_notes": [(r"(?i)^ppt/notesSlides/notesSlide\d+\.xml$", None)],
        "charts": [(r"(?i)^ppt/charts/chart\d+\.xml$", None)],
        "embedded_objects": [(r"^ppt/embeddings/.*[^/]$", None)],
        "macro_parts": [(r"(?i)ppt/vbaProject\.bin$", None)],
    },
    "odf": {
        "paragraphs": [(r"^content\.xml$", r"<text:p(?:\s|>)")],
        "headings": [(r"^content\.xml$", r"<text:h(?:\s|>)")],
        "tables": [(r"^content\.xml$", r"<table:table(?:\s|>)")],
        "images": [(r"^Pictures/.*[^/]$", None)],
        "comments": [(r"^content\.xml$", r"<office:annotation(?:\s|>)")],
        "tracked_changes": [(r"^content\.xml$", r"<text:(?:tracked-changes|changed-region)(?:\s|>)")],
        "footnotes": [(r"^content\.xml$", r"""<text:note\b[^>]*text:note-class=["']footnote["']""")],
        "endnotes": [(r"^content\.xml$", r"""<text:note\b[^>]*text:note-class=["']endnote["']""")],
        "equations": [(r"^content\.xml$", r"<math:math(?:\s|>)")],
        "sections": [(r"^content\.xml$", r"<text:section(?:\s|>)")],
        "slides": [(r"^content\.xml$", r"<draw:page(?:\s|>)")],
        "speaker_notes": [(r"^content\.xml$", r"<presentation:notes(?:\s|>)")],
        "embedded_objects": [(r"^Object(?:Replacements)?/", None)],
        "external_links": [(r"^content\.xml$", r"""(?i)xlink:href=["'](?:https?:|file:|ftp:)""")],
    },
    "ebook": {
        "sections": [(r"\.opf$", r"(?i)<itemref(?:\s|>)")],
        "images": [(r"(?i)\.(?:png|jpe?g|gif|webp|svg|avif)$", None)],
    },
}
FORMAT_FAMILY = {"docx": "writer", "docm": "writer", "pptx": "presentation", "pptm": "presentation", "odt": "odf",
                 "odp": "odf", "epub": "ebook"}
COUNTERS = ["paragraphs", "headings", "tables", "images", "comments", "tracked_changes", "footnotes", "endnotes",
            "equations", "sections", "slides", "speaker_notes", "charts", "embedded_objects", "external_links"]
FONTS = {"word/fontTable.xml": r"""<w:font\b[^>]*w:name=["']([^"']+)["']""",
         "styles.xml": r"""<style:font-face\b[^>]*style:name=["']([^"']+)["']"""}
MACRO_WARNING = "Holds a macro project; such packages are not opened for writing."
LEGACY_WARNING = "A binary container from before the package formats: only its frame was read, so macros may be inside."


def _external_links() -> Column:
    return count_matches(utf8(F.col("content")), r"""(?i)TargetMode\s*=\s*["']External["']""")


def external_relationships(members: DataFrame, archive: str = "archive_id") -> DataFrame:
    """``(archive, external_links)``: external targets in all relationship parts."""
    parts = members.where(F.col("path").endswith(".rels"))
    return parts.groupBy(archive).agg(F.sum(_external_links()).alias("external_links"))


def inspect_packages(members: DataFrame, files: DataFrame, archive: str = "archive_id") -> DataFrame:
    """One profile per file of ``files (archive, format_id)``; counters that a format does not have are null.

    The members are decoded once and grouped once. Files and profiles are as many as the packages, and what decoding makes of
    a small file is not known beforehand, so neither is ever broadcast.
    """
    family_of = F.lit(None).cast("string")
    for fmt, name in FORMAT_FAMILY.items():
        family_of = F.when(F.col("format_id") == fmt, name).otherwise(family_of)
    known = files.select(archive, "format_id", family_of.alias("family"))
    path, text = F.col("path"), utf8(F.col("content"))
    # members that were too large to read count as entries; the profile says that it lacks them
    unread = F.col("error").startswith("PACKAGE_MEMBER_LIMIT")
    joined = members.where(F.col("error").isNull() | unread).join(known.hint("merge"), archive)

    # the package document of an EPUB: the one its container names, else the first
    ebook = F.col("family") == "ebook"
    rootfile = F.max(F.when(ebook & (path == "META-INF/container.xml"),
                            F.nullif(F.regexp_extract(text, r"""(?i)full-path=["']([^"']+\.opf)["']""", 1), F.lit(""))))
    first_opf = F.min(F.when(ebook & path.endswith(".opf"), F.struct("idx", "path")))["path"]
    in_root = {n: [p for _, p in c if p] for n, c in FAMILIES["ebook"].items() if any(p for _, p in c)}

    def tally(name: str) -> Column:
        total = F.lit(None).cast("bigint")
        for family, counters in FAMILIES.items():
            for member, pattern in counters.get(name, []):
                where = (F.col("family") == family) & path.rlike(member)
                if family == "ebook" and pattern:
                    continue  # counted in the package document
                value = F.lit(1).cast("bigint") if pattern is None else count_matches(text, pattern)
                total = F.when(where, value).otherwise(total)
        return F.sum(total).alias(name)

    core = path.isin("docProps/core.xml", "meta.xml")
    author = F.when(F.col("family") == "odf", xml_value(text, "meta:initial-creator")).otherwise(xml_value(text, "dc:creator"))
    # facts of a few documents per EPUB, until it is known which of them is its package document
    document = F.struct(path.alias("path"), xml_value(text, "dc:title").alias("title"), author.alias("author"), *[
        F.when(ebook, sum((count_matches(text, p) for p in ps[1:]), count_matches(text, ps[0]))).alias(n) for n, ps in in_root.items()])
    fonts = F.lit(None).cast("array<string>")
    for member, pattern in FONTS.items():
        fonts = F.when(path == member, match_values(text, pattern)).otherwise(fonts)
    totals = joined.groupBy(archive).agg(
        F.count(F.lit(1)).alias("package_entries"), F.sum("size").cast("bigint").alias("expanded_size"),
        *[tally(c) for c in [*COUNTERS, "macro_parts"]],
        F.max(F.when(core, xml_value(text, "dc:title"))).alias("title"), F.max(F.when(core, author)).alias("author"),
        F.max(fonts).alias("fonts"), F.sort_array(F.collect_set(F.when(unread, F.col("error")))).alias("unread"),
        F.sum(F.when(F.col("family").isin("writer", "presentation") & path.endswith(".rels"), _external_links())).alias("rel_links"),
        F.coalesce(rootfile, first_opf).alias("root"), F.collect_list(F.when(path.endswith(".opf"), document)).alias("documents"))
    totals = totals.withColumn("documents", F.filter("documents", lambda d: d["path"] == F.col("root")))
    for name in in_root:
        counted = F.aggregate("documents", F.col(name), lambda n, d: F.coalesce(n + d[name], n, d[name]))  # noqa: B023
        totals = totals.withColumn(name, counted)
    for name in ("title", "author"):
        totals = totals.withColumn(name, F.greatest(name, F.array_max(F.transform("documents", lambda d: d[name]))))  # noqa: B023
    merged = known.join(totals.hint("merge"), archive, "left")

    out = merged
    for counter in COUNTERS:
        has = F.lit(False)
        for family, counters in FAMILIES.items():
            present = counter in counters or (counter == "external_links")
            if present:
                has = has | (F.col("family") == family)
        value = F.coalesce(F.col(counter), F.lit(0))
        if counter in ("footnotes", "endnotes"):
            # the two separators that every writer package holds are no notes
            value = F.when(F.col("family") == "writer", F.greatest(value - 2, F.lit(0))).otherwise(value)
        if counter in ("slides", "speaker_notes"):
            has = has & (F.col("format_id") != "odt")
        if counter == "external_links":
            value = F.coalesce("rel_links", "external_links", F.lit(0).cast("bigint"))
        out = out.withColumn(counter, F.when(has, value))
    legacy = F.col("format_id").isin("doc", "ppt")
    macros = (F.coalesce("macro_parts", F.lit(0)) > 0) & F.col("family").isin("writer", "presentation")
    what = F.when(F.col("family") == "odf", " link(s) point outside the package and were left alone.").otherwise(
        " relationship(s) point outside the package and were left alone.")
    return out.withColumn("macros", legacy | F.coalesce(macros, F.lit(False))).withColumn("warnings", F.concat(F.coalesce("unread", F.array().cast("array<string>")), F.array_compact(F.array(
        F.when(legacy, LEGACY_WARNING), F.when(macros, MACRO_WARNING),
        F.when(F.col("external_links") > 0, F.concat(F.col("external_links").cast("string"), what)))))).withColumn(
        "fonts", F.coalesce("fonts", F.array().cast("array<string>"))).select(
        archive, "format_id", "package_entries", "expanded_size", *COUNTERS, "macros", "fonts", "title", "author", "warnings")
