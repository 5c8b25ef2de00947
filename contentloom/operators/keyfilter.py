"""A Bloom filter over the keys that are wanted, tested where a table is scanned."""

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each key, at least: one in sixteen of the other rows passes.
BITS_PER_KEY = 16
#: The filter has at most so many bits, 16 MB, which may be broadcast. More keys let more rows pass.
MOST_BITS = 1 << 27
_MAP_BITS = 1 << 15


class KeyFilter:
    """Bitmaps of the hashes of ``keys``, a table. Nothing runs until a plan that uses them does."""

    def __init__(self, keys: DataFrame, key: str):
        self.key = key
        bits = F.count("*") * BITS_PER_KEY
        # The next power of two, so that the number of whole bitmaps is one as well.
        size = F.least(F.greatest(F.pow(F.lit(2), F.ceil(F.log2(bits + 1))), F.lit(_MAP_BITS)), F.lit(MOST_BITS)).cast("long")
        self.size = keys.agg(size.alias("size")).scalar()
        known = keys.where(F.col(key).isNotNull()).select(self._part().alias("part"), self._bit().alias("bit"))
        self.maps = known.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def _place(self) -> Column:
        return F.pmod(F.xxhash64(self.key), self.size)

    def _part(self) -> Column:
        return F.shiftright(self._place(), 15)

    def _bit(self) -> Column:
        return self._place().bitwiseAND(_MAP_BITS - 1)

    def _tested(self, rows: DataFrame, how: str) -> tuple[DataFrame, Column]:
        met = rows.join(F.broadcast(self.maps), self._part() == F.col("part"), how)
        byte = F.ascii(F.decode(F.substring("bits", F.shiftright(self._bit().cast("int"), 3) + 1, F.lit(1)), "ISO-8859-1"))
        met = met.withColumn("byte", byte).withColumn("bit", self._bit().cast("int"))
        return met, F.expr("shiftright(byte, bit & 7) & 1 = 1")

    def maybe_wanted(self, rows: DataFrame) -> DataFrame:
        """``rows`` without most of those whose key is not there, and with all whose key is.

        Rows are tested in the scan's own tasks, so what is left out is never shuffled. An exact
        inner join with the keys is to follow (Spark would move a semi join below this one).
        """
        met, isset = self._tested(rows, "inner")
        return met.where(isset).select(*rows.columns)

    def surely_unwanted(self, rows: DataFrame) -> DataFrame:
        """The other rows: their key, if they have one, is not there."""
        met, isset = self._tested(rows, "left")
        return met.where(~F.coalesce(isset, F.lit(False))).select(*rows.columns)
