"""XMP sidecars: marks and keywords read, packets written, and what other programs wrote kept where a sidecar is brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of colour labels, by number from 1; namespaces; the packet's frame.
LABELS = ("Red", "Yellow", "Green", "Blue", "Purple")
XMP, DC, LR = "http://ns.adobe.com/xap/1.0/", "http://purl.org/dc/elements/1.1/", "http://ns.adobe.com/lightroom/1.0/"
HEAD = '''<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'''
TAIL = """
 </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>"""
#: Larger sidecars are neither read nor written.
MOST_BYTES = 4 << 20
#: Quoted values may hold a >.
TAG_END = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""


def _first(text: Column, pattern: Column | str, group: int = 1) -> Column:
    """The group of the first match, null without one; the pattern may differ from row to row."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group)), F.lit(0))


def prefix_of(text: Column, namespace: str) -> Column:
    """The prefix that a text declares for a namespace; null if none."""
    return _first(text, rf"""xmlns:([\w-]+)=["']{namespace}["']""")


def _attribute(prefix: Column, name: str) -> Column:
    return F.concat(F.lit(r"\s+"), prefix, F.lit(rf""":{name}\s*=\s*("[^"]*"|'[^']*')"""))


def _element(prefix: Column, name: str) -> Column:
    return F.concat(F.lit("(?s)<"), prefix, F.lit(f":{name}>(.*?)</"), prefix, F.lit(f":{name}>"))


def prop(text: Column, namespace: str, name: str) -> Column:
    """A property of the namespace, whatever prefix the text gives it, as an attribute or an element; null if absent."""
    prefix = prefix_of(text, namespace)
    quoted = _first(text, _attribute(prefix, name))
    return F.coalesce(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.trim(_first(text, _element(prefix, name))))


def marks(text: Column) -> Column:
    """rating, flag and label of a sidecar: a rating of -1 means rejected; other names of labels than LABELS count as none."""
    rating = F.try_to_number(F.trim(prop(text, XMP, "Rating")), F.lit("S9")).cast("int")
    label = F.array_position(F.array(*(F.lit(x.lower()) for x in LABELS)), F.lower(F.trim(prop(text, XMP, "Label")))).cast("int")
    return F.struct(
        F.when(rating.between(0, 5), rating).otherwise(0).alias("rating"), F.when(rating == -1, -1).otherwise(0).alias("flag"), F.coalesce(label, F.lit(0)).alias("label")
    )


def _subject(prefix: Column) -> Column:
    return F.concat(F.lit("(?s)<"), prefix, F.lit(r":subject(?:\s[^>]*)?>(.*?)</"), prefix, F.lit(":subject>"))


def _items(bag: Column) -> Column:
    found = F.transform(F.regexp_extract_all(bag, F.lit(r"(?s)<rdf:li(?:\s[^>]*)?(?<!/)>\s*(.*?)\s*</rdf:li>"), F.lit(1)), unescaped)
    return F.filter(found, lambda x: x != "")


def keywords(text: Column) -> Column:
    """The entries of the subject bag; an empty array without one."""
    return F.coalesce(_items(_first(text, _subject(prefix_of(text, DC)))), F.array().cast("array<string>"))


def unescaped(c: Column) -> Column:
    """Text without XML's predefined entities, and without references by number of the signs that they stand for and of the hyphen."""
    for n in (0x22, 0x26, 0x27, 0x2D, 0x3C, 0x3E):
        c = F.regexp_replace(c, rf"&#(?:0*{n}|x0*{n:x}|x0*{n:X});", "&amp;" if n == 0x26 else chr(n))
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(sign))
    return c


def escaped(c: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def _shown(rating: Column, flag: Column, label: Column) -> tuple[Column, Column]:
    """The rating and the label as they are written; null where there is none."""
    stars = F.when(flag == -1, F.lit("-1")).when(rating > 0, F.least(rating, F.lit(5)).cast("string"))
    name = F.lit(None).cast("string")
    for i, x in enumerate(LABELS, 1):
        name = F.when(label == i, x).otherwise(name)
    return stars, name


def _bag(prefix: Column, names: Column, indent: Column) -> Column:
    """The subject element, on lines of their own."""
    items = F.array_join(F.transform(names, lambda x: F.concat(F.lit("\n"), indent, F.lit("  <rdf:li>"), escaped(x), F.lit("</rdf:li>"))), "")
    return F.concat(F.lit("<"), prefix, F.lit(":subject>\n"), indent, F.lit(" <rdf:Bag>"), items, F.lit("\n"), indent, F.lit(" </rdf:Bag>\n"), indent, F.lit("</"), prefix, F.lit(":subject>"))


def _put(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def packet(rating: Column, flag: Column, label: Column, names: Column, title: Column | None = None, caption: Column | None = None) -> Column:
    """A sidecar's text; null for a photo without a mark, keyword, title or caption. Picks have no property of their own."""
    stars, called = _shown(rating, flag, label)
    alt = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f'\n   <dc:{tag}>\n    <rdf:Alt>\n     <rdf:li xml:lang="x-default">'), escaped(c), F.lit(f"</rdf:li>\n    </rdf:Alt>\n   </dc:{tag}>")))
    parts = [F.when(F.size(names) > 0, F.concat(F.lit("\n   "), _bag(F.lit("dc"), names, F.lit("   ")))), *(alt(t, c) for t, c in (("title", title), ("description", caption)) if c is not None)]
    inner = F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
    close = F.when(inner == "", F.lit("/>")).otherwise(F.concat(F.lit(f' xmlns:dc="{DC}">'), inner, F.lit("\n  </rdf:Description>")))
    return F.when(stars.isNotNull() | called.isNotNull() | (inner != ""), F.concat(F.lit(HEAD), _put("xmp:Rating", stars), _put("xmp:Label", called), close, F.lit(TAIL)))


def _without(text: Column, prefix: Column, name: str) -> Column:
    text = F.regexp_replace(text, _attribute(prefix, name), F.lit(""))
    return F.regexp_replace(text, F.concat(F.lit(r"(?s)[ \t]*<"), prefix, F.lit(f":{name}>.*?</"), prefix, F.lit(rf":{name}>(?:\r?\n)?")), F.lit(""))


def _quoted(c: Column) -> Column:
    """Text for a replacement, in which backslashes and dollars stand for themselves."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def _with_keywords(text: Column, names: Column) -> Column:
    """text with its subject bag replaced by names, and paths of keywords cut to those whose last part is among them."""
    dc = prefix_of(text, DC)
    line = F.concat(F.lit(r"(?s)(?:(?<=\n)[ \t]*)?<"), dc, F.lit(r":subject(?:\s[^>]*)?>.*?</"), dc, F.lit(r":subject>(?:\r?\n)?"))
    bare = F.coalesce(F.regexp_replace(text, line, F.lit("")), text)
    lr = prefix_of(bare, LR)
    tree = F.concat(F.lit("(?s)<"), lr, F.lit(r":hierarchicalSubject(?:\s[^>]*)?>(.*?)</"), lr, F.lit(":hierarchicalSubject>"))
    paths = F.coalesce(_items(_first(bare, tree)), F.array().cast("array<string>"))
    gone = F.filter(paths, lambda p: ~F.array_contains(names, F.trim(F.element_at(F.split(p, r"\|"), -1))))
    whole = F.concat(F.lit(r"(?s)(?:(?<=\n)[ \t]*)?<"), lr, F.lit(r":hierarchicalSubject(?:\s[^>]*)?>.*?</"), lr, F.lit(r":hierarchicalSubject>(?:\r?\n)?"))
    each = F.concat(F.lit(r"(?:(?<=\n)[ \t]*)?<rdf:li(?:\s[^>]*)?>\s*(?:\Q"), F.array_join(F.transform(gone, escaped), r"\E|\Q"), F.lit(r"\E)\s*</rdf:li>(?:\r?\n)?"))
    cut = F.when((F.size(paths) > 0) & (F.size(gone) == F.size(paths)), F.regexp_replace(bare, whole, F.lit(""))).when(F.size(gone) > 0, F.regexp_replace(bare, each, F.lit(""))).otherwise(bare)
    indent = F.coalesce(_first(cut, r"(?m)^([ \t]*)<rdf:Description"), F.lit(""))
    bag = F.concat(indent, F.lit(" "), _bag(F.coalesce(dc, F.lit("dc")), names, F.concat(indent, F.lit(" "))))
    declared = F.when(dc.isNull(), F.lit(f' xmlns:dc="{DC}"')).otherwise("")
    # The first description: one that closes itself is opened.
    shut = rf"(?s)^(.*?<rdf:Description{TAG_END})\s*/>"
    opened = F.regexp_replace(cut, F.lit(shut), F.concat(F.lit("$1"), _quoted(F.concat(declared, F.lit(">\n"), bag, F.lit("\n"), indent, F.lit("</rdf:Description>")))))
    inside = F.regexp_replace(cut, F.lit(rf"(?s)^(.*?<rdf:Description{TAG_END})>"), F.concat(F.lit("$1"), _quoted(F.concat(declared, F.lit(">\n"), bag))))
    return F.when(F.size(names) == 0, cut).when(cut.rlike(rf"(?s)^(?:(?!<rdf:Description).)*<rdf:Description{TAG_END}/>"), opened).otherwise(inside)


def _bare(text: Column) -> Column:
    squeezed = F.replace(F.regexp_replace(text, r"\s+", ""), F.lit(f'xmlns:dc="{DC}"'), F.lit(""))
    return F.replace(squeezed, F.lit("></rdf:Description>"), F.lit("/>"))


def updated(rows: DataFrame, match: Column | None = None) -> DataFrame:
    """rows (text, rating, flag, label, names; any others) with action, written, deleted, unchanged or unreadable, and new_text, the text to write.

    text is what the sidecar holds, null for none. Only rating, label and, where match says so, keywords change; all else stays byte for byte. match is
    true by default for photos with keywords: a sidecar may hold those of another program. A sidecar without anything left is deleted if it
    is one that packet writes. A text without a description can't be changed.
    """
    rows = rows.withColumn("_match", F.size("names") > 0 if match is None else match)
    text, names = F.col("text"), F.col("names")
    stars, called = _shown(F.col("rating"), F.col("flag"), F.col("label"))
    rows = rows.withColumns({"_p": prefix_of(text, XMP), "_stars": stars, "_called": called, "_fresh": packet(F.col("rating"), F.col("flag"), F.col("label"), names)})
    same_names = ~F.col("_match") | (F.array_sort(keywords(text)) == F.array_sort(names))
    same_marks = prop(text, XMP, "Rating").eqNullSafe(F.col("_stars")) & prop(text, XMP, "Label").eqNullSafe(F.col("_called"))
    rows = rows.withColumns({"_same_names": same_names, "_same_marks": same_marks})
    rows = rows.withColumn("_t1", F.when(F.col("_same_names"), text).otherwise(_with_keywords(text, names)))
    p = F.coalesce("_p", F.lit("xmp"))
    cleared = _without(_without(F.col("_t1"), p, "Rating"), p, "Label")
    rows = rows.withColumn("_t2", F.when(F.col("_same_marks"), F.col("_t1")).otherwise(cleared))
    said = F.concat(F.when(F.col("_p").isNull(), F.lit(f' xmlns:xmp="{XMP}"')).otherwise(""), *(F.coalesce(F.concat(F.lit(" "), p, F.lit(f':{n}="'), F.col(c), F.lit('"')), F.lit("")) for n, c in (("Rating", "_stars"), ("Label", "_called"))))
    some = F.col("_stars").isNotNull() | F.col("_called").isNotNull()
    put = F.regexp_replace(F.col("_t2"), F.lit("(?s)^(.*?<rdf:Description)"), F.concat(F.lit("$1"), _quoted(said)))
    rows = rows.withColumn("_t3", F.when(some & ~F.col("_same_marks"), put).otherwise(F.col("_t2")))
    adds = (some & ~F.col("_same_marks")) | (~F.col("_same_names") & (F.size("names") > 0))
    action = (
        F.when(text.isNull(), F.when(F.col("_fresh").isNull(), "unchanged").otherwise("written"))
        .when(F.col("_same_names") & F.col("_same_marks"), "unchanged")
        .when(adds & ~text.contains("<rdf:Description"), "unreadable")
        .when(_bare(F.col("_t3")) == _bare(F.lit(HEAD + "/>" + TAIL)), "deleted")
        .when(F.col("_t3") == text, "unchanged")
        .otherwise("written")
    )
    rows = rows.withColumn("action", action).withColumn("new_text", F.when(F.col("action") == "written", F.when(text.isNull(), F.col("_fresh")).otherwise(F.col("_t3"))))
    return rows.drop("_match", "_p", "_stars", "_called", "_fresh", "_same_names", "_same_marks", "_t1", "_t2", "_t3")


def path_for(raw: Column) -> Column:
    """Where the sidecar of a file is: .xmp in place of its extension."""
    return F.concat(F.regexp_replace(raw, r"\.[^./\\]*$", ""), F.lit(".xmp"))


def read(files: DataFrame) -> DataFrame:
    """path, rating, flag, label and keywords of sidecars (path, content) of at most MOST_BYTES."""
    text = F.decode("content", F.lit("UTF-8"))
    return files.filter(F.length("content") <= MOST_BYTES).select("path", marks(text).alias("m"), keywords(text).alias("keywords")).select("path", "m.*", "keywords")


def beside(raws: DataFrame, sidecars: DataFrame) -> DataFrame:
    """What sidecars (as read gives them) say on RAW files (path): path, rating, flag, label and keywords of those with any; two RAWs of one name share one."""
    said = sidecars.filter("rating <> 0 OR flag <> 0 OR label <> 0 OR size(keywords) > 0").withColumnRenamed("path", "_at")
    return raws.select("path", path_for(F.col("path")).alias("_at")).join(said, "_at").drop("_at")


def sync(photos: DataFrame, sidecars: DataFrame, raw_extensions: list[str], keywords_changed: bool = False, key: str | None = None) -> DataFrame:
    """path, action and new_text for the sidecar of each RAW file of photos (path, rating, flag, label, names), given the texts there (path, text).

    RAW files themselves, and files of other formats, get nothing. Texts over MOST_BYTES are unreadable. key: a column of both tables that tells
    files of one path apart, where tables hold several; without it sidecars have a row for each path at most.
    """
    raws = photos.filter(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin([e.lower() for e in raw_extensions]))
    by = ["path", *([key] if key else [])]
    held = raws.withColumn("path", path_for(F.col("path"))).select(*by, "rating", "flag", "label", "names").join(sidecars.select(*by, "text"), by, "left")
    out = updated(held, (F.size("names") > 0) | F.lit(keywords_changed))
    large = F.octet_length("text") > MOST_BYTES
    return out.select("path", F.when(large, "unreadable").otherwise(F.col("action")).alias("action"), F.when(~F.coalesce(large, F.lit(False)), F.col("new_text")).alias("new_text"))
