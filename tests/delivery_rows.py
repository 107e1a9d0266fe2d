"""Small deliveries that tests build their tables from."""


def raw_ddl():
    """Identifiers are whole numbers, places are decimals, the rest is text."""
    from milepost.schemas import RAW_COLUMNS

    def kind(name):
        if name in ("lng", "lat") or name.endswith(("_lng", "_lat")):
            return "double"
        return "bigint" if name.endswith("_id") or name == "aoi_type" else "string"

    return ", ".join(f"{c} {kind(c)}" for c in RAW_COLUMNS)


def raw_row(order_id=1, **changes):
    """A flawless delivery of 105 minutes."""
    day, place = "06-12", (121.4, 37.5)
    row = {"order_id": order_id, "region_id": 5, "city": "Yantai", "courier_id": 11,
           "aoi_id": 51, "aoi_type": 2, "ds": day.replace("-", "")}
    row["lng"], row["lat"] = place
    for k, (step, clock) in enumerate((("accept", "10:10:00"), ("delivery", "11:55:00"))):
        row[f"{step}_time"] = row[f"{step}_gps_time"] = f"{day} {clock}"
        row[f"{step}_gps_lng"], row[f"{step}_gps_lat"] = place[0] + k / 50, place[1] + k / 50
    return row | changes


def raw_frame(spark, rows):
    from milepost.schemas import RAW_COLUMNS

    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], raw_ddl())


def golden_raw(spark):
    """A flawless row, and one past midnight (35 minutes) without its acceptance position."""
    late = {f"accept{x}": "06-12 23:50:00" for x in ("_time", "_gps_time")}
    late |= {f"delivery{x}": "06-12 00:25:00" for x in ("_time", "_gps_time")}
    late |= {"accept_gps_lng": None, "accept_gps_lat": None, "courier_id": 12}
    return raw_frame(spark, [raw_row(1), raw_row(2, **late)])


def silver_frame(spark):
    """Four deliveries: on time, late, unusable, on time without delivery position."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    cases = [
        # order, region, city, courier, aoi, day, minutes, status, positions, warned
        (1, 5, "Yantai", 11, 51, 12, 75, "normal", "both", False),
        (2, 5, "Yantai", 11, 52, 12, 255, "normal", "both", True),
        (3, 5, "Yantai", 12, 53, 12, 0, "zero_or_negative", "none", True),
        (4, 6, "Jilin", 21, 61, 13, 150, "normal", "accept", False),
    ]
    ddl = ("order_id bigint, region_id bigint, city string, courier_id bigint, aoi_id bigint, "
           "start timestamp, minutes double, status string, positions string, warned boolean")
    rows = [(o, r, c, k, a, datetime(2000, 6, d, 9), float(m), s, p, w)
            for o, r, c, k, a, d, m, s, p, w in cases]
    df = spark.createDataFrame(rows, ddl)
    end = [r[5] + timedelta(minutes=r[6]) for r in rows]
    ends = spark.createDataFrame([(r[0], e) for r, e in zip(rows, end, strict=True)],
                                 "order_id bigint, finish timestamp")
    ok = {"accept": F.col("positions") != "none", "delivery": F.col("positions") == "both"}
    place = {"lng": 121.4, "lat": 37.5}
    columns = {
        "aoi_type": F.lit(2).cast("bigint"), "partition_timestamp": F.date_trunc("day", "start"),
        "accept_timestamp": F.col("start"), "delivery_timestamp": F.col("finish"),
        "delivery_duration_minutes": F.col("minutes"),
        "delivery_duration_status": F.col("status"),
        **{f"{s}_gps_{x}_clean": F.when(ok[s], v) for s in ok for x, v in place.items()},
        **{f"{s}_gps_valid": ok[s] for s in ok},
        "gps_quality_status": F.when(ok["delivery"], "complete").otherwise("missing"),
        "is_quality_warning": F.col("warned"), "_quality_warning_count": F.col("warned").cast("int"),
        "_source_file": F.lit("part.csv"), "_source_sha256": F.lit("c" * 64),
        "_dataset_revision": F.lit("one"), "_silver_processed_at": F.col("start"),
        "_silver_version": F.lit("1.0"),
    }
    df = df.join(ends, "order_id")
    keys = ["order_id", "region_id", "city", "courier_id", "aoi_id"]
    return df.select(*keys, *[x.alias(c) for c, x in columns.items()])
