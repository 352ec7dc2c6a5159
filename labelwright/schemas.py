"""Declared schemas of file sources; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT_LINE = T.StructType(
    [
        T.StructField("barcode", T.StringType()),
        T.StructField("productName", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("countryTags", T.ArrayType(T.StringType())),
        T.StructField("imageType", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)

MANIFEST_IMAGE = T.StructType(
    [
        T.StructField("imageId", T.LongType()),
        T.StructField("productId", T.StringType()),
        T.StructField("view", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("split", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("images", T.ArrayType(MANIFEST_IMAGE)),
        T.StructField("productSplits", T.MapType(T.StringType(), T.StringType())),
    ]
)

ANNOTATION = T.StructType(
    [
        T.StructField("annotationId", T.LongType()),
        T.StructField("imageId", T.LongType()),
        T.StructField("classId", T.IntegerType()),
        T.StructField(
            "boundingBox",
            T.StructType([T.StructField(n, T.DoubleType()) for n in ("xCenter", "yCenter", "width", "height")]),
        ),
        T.StructField("provenance", T.StringType()),
        T.StructField("verificationStatus", T.StringType()),
    ]
)
