"""Drawing files encoded from the part table: one PDF of one page for each part, as text.

The page is 600 by 800 points from (5, 7), turned by 90 degrees times p_partkey % 4.  Its content
holds a line, a scaled filled rectangle, a closed path of a layer with a line after it, a form and
two texts.  Contents are plain, as hex digits, or run-length coded and then as hex digits
(p_partkey % 3); the font and the layer lie in an object stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 100


def _run_length_hex(text: Column) -> Column:
    """Literal runs of up to RUN bytes, each after its length less one, and the end mark."""
    starts = F.sequence(F.lit(1), F.length(text), F.lit(RUN))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(RUN)))
    coded = F.transform(runs, lambda r: F.concat(F.lpad(F.hex(F.length(r) - 1), 2, "0"), F.hex(r)))
    return F.concat(F.array_join(coded, ""), F.lit("80>"))


def sheets(part: DataFrame) -> DataFrame:
    """(path, content) of each part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    k, at = key % 100, 300 + size
    content = F.concat_ws(
        "\n",
        F.format_string("2 w %d 10 m %d 10 l S", k, k + size),
        F.format_string("q 2 0 0 2 10 20 cm 50 50 %d %d re f Q", size, size),
        F.format_string("/OC /L0 BDC 300 300 m %d 300 l %d 310 l h 330 330 l S EMC /X0 Do", at, at),
        F.format_string("BT /F1 12 Tf 14 TL 1 0 0 1 %d 500 Tm (%s) Tj T* <%s> Tj ET", k, F.col("p_name"), F.hex(F.format_string("#%d", key))),
    )
    coded = F.when(key % 3 == 0, content).when(key % 3 == 1, F.concat(F.hex(content), F.lit(">"))).otherwise(_run_length_hex(content))
    filters = F.when(key % 3 == 0, "").when(key % 3 == 1, "/Filter/ASCIIHexDecode").otherwise("/Filter[/ASCIIHexDecode/RunLengthDecode]")
    form = F.format_string("0 0 m 40 %d l S", k)
    font, layer = "<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", "<</Type/OCG/Name(A-WALL)>>"
    index = f"5 0 7 {len(font) + 1} "
    file = F.concat_ws(
        "\n",
        F.lit("%PDF-1.7\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[5 7 605 807]>> endobj"),
        F.format_string("3 0 obj <</Type/Page/Parent 2 0 R/Rotate %d/Contents 4 0 R", 90 * (key % 4)),
        F.lit("/Resources<</Font<</F1 5 0 R>>/Properties<</L0 7 0 R>>/XObject<</X0 8 0 R>>>>>> endobj"),
        F.format_string("4 0 obj <</Length %d%s>> stream", F.length(coded), filters),
        coded,
        F.lit(f"endstream endobj\n6 0 obj <</Type/ObjStm/N 2/First {len(index)}/Length {len(index) + len(font) + 1 + len(layer)}>> stream\n{index}{font} {layer}\nendstream endobj"),
        F.format_string("8 0 obj <</Type/XObject/Subtype/Form/Matrix[1 0 0 1 %d 5]/Length %d>> stream", size, F.length(form)),
        form,
        F.lit("endstream endobj\ntrailer <</Root 1 0 R>>\n%%EOF"),
    )
    return part.select(key.cast("string").alias("path"), file.cast("binary").alias("content"))
