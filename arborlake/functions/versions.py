"""Versions, update manifests and access rights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_parts(version: Column) -> Column:
    """Two to four numbers, padded to four; null if it is no version."""
    parts = F.transform(F.split(F.trim(version), r"\."), lambda p: p.cast("int"))
    padded = F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 4)
    return F.when(F.trim(version).rlike(r"^\d{1,9}(\.\d{1,9}){1,3}$"), padded)


def is_newer(offered: Column, running: Column) -> Column:
    """Whether the offered version is above the running one; false if either is no version."""
    return F.coalesce(version_parts(offered) > version_parts(running), F.lit(False))


def well_formed(xml: Column) -> Column:
    """Whether a text is one XML document; a blank or null text is none."""
    parsed = F.from_xml(F.concat(F.lit("<all>"), F.regexp_replace(xml, r"^\s*<\?xml[^>]*\?>", ""), F.lit("</all>")), "_bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return F.coalesce(parsed.isNotNull() & parsed["_bad"].isNull() & xml.rlike("<"), F.lit(False))


def manifest_fields(xml: Column) -> Column:
    """version, url and about below appinfo, trimmed and null if blank or missing, and what is wrong with the document (null if nothing)."""
    ok = well_formed(xml)
    # without what may not stand in an element, xpath takes several roots as one document; it is never given another
    inside = F.when(ok, F.concat(F.lit("<all>"), F.regexp_replace(xml, r"^\s*<\?xml[^>]*\?>", ""), F.lit("</all>")))
    roots = F.xpath_int(inside, F.lit("count(/all/*)"))
    one = ok & (roots == 1)

    def field(name):
        text = F.trim(F.when(one, F.xpath_string(inside, F.lit(f"/all/appinfo/{name}"))))
        return F.when(F.length(text) > 0, text)

    version, url, about = map(field, ("version", "url", "about"))
    root = F.xpath_boolean(inside, F.lit("/all/appinfo"))
    error = (
        F.when(~ok | (roots != 1), "not well-formed").when(~root, "no appinfo element").when(version.isNull(), "no version").when(version_parts(version).isNull(), "not a version").when(url.isNull(), "no url")
    )
    return F.struct(version.alias("version"), url.alias("url"), about.alias("about"), error.alias("error"))


#: Bits of file rights.
FULL_CONTROL, MODIFY, READ_EXECUTE, WRITE, READ = 0x1F01FF, 0x301BF, 0x200A9, 0x116, 0x20089


#: Names of single rights, by their bits.
RIGHTS = {
    0x1: "ReadData", 0x2: "WriteData", 0x4: "AppendData", 0x8: "ReadExtendedAttributes", 0x10: "WriteExtendedAttributes", 0x20: "ExecuteFile",
    0x40: "DeleteSubdirectoriesAndFiles", 0x80: "ReadAttributes", 0x100: "WriteAttributes", 0x10000: "Delete", 0x20000: "ReadPermissions",
    0x40000: "ChangePermissions", 0x80000: "TakeOwnership", 0x100000: "Synchronize",
}


def rights_label(mask: Column) -> Column:
    """`Full control` or `Modify`, else reading and writing rights side by side; any other mask as the names of its
    rights, or as a number if it has bits without a name or none at all."""
    has = lambda bits: mask.bitwiseAND(F.lit(bits)) == bits
    reads = F.when(has(READ_EXECUTE), "Read & execute").when(has(READ), "Read")
    both = F.concat_ws(", ", reads, F.when(has(WRITE), "Write"))
    names = F.concat_ws(", ", *(F.when(has(bit), name) for bit, name in RIGHTS.items()))
    named = (mask.bitwiseAND(F.lit(~sum(RIGHTS))) == 0) & (mask != 0)
    raw = F.when(named, names).otherwise(mask.cast("string"))
    return F.when(has(FULL_CONTROL), "Full control").when(has(MODIFY), "Modify").when(both != "", both).otherwise(raw)


def acl_order() -> list[Column]:
    """Explicit rules first, denials first, then by identity."""
    return [F.col("inherited"), F.desc("deny"), F.col("identity")]
