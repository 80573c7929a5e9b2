"""Transcripts of radio speech: spoken callsigns of any airline, and who is speaking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.text import any_of, spoken_digits

# Spoken names of airlines and their codes.
AIRLINES = {
    "中国国际": "CCA", "国际": "CCA", "国航": "CCA", "东方": "CES", "东航": "CES", "南方": "CSN", "南航": "CSN", "上海": "CSH", "上航": "CSH",
    "吉祥": "DKH", "春秋": "CQH", "海南": "CHH", "海航": "CHH", "四川": "CSC", "川航": "CSC", "山东": "CDG", "山航": "CDG", "深圳": "CSZ",
    "深航": "CSZ", "厦门": "CXA", "厦航": "CXA", "白鹭": "CXA", "成都": "UEA", "联合": "CUA", "中联航": "CUA", "河北": "HBH", "首都": "CBJ",
    "天津": "GCR", "奥凯": "OKA", "昆明": "KNA", "长龙": "CDC", "华夏": "HXA", "祥鹏": "LKE", "东海": "EPA", "西部": "CHB", "瑞丽": "RLH",
    "青岛": "QDA", "邮政": "CYZ",
}
DIGITS = "0-9零洞幺一两二三四五六拐七八九"
# What a controller says.
CONTROLLER_CUES = ("雷达看到", "雷达识别", "上到", "下降到", "下到", "保持高度", "速度", "左转", "右转", "航向", "联系", "修正海压", "可以进近")
# What is said when reading back.
READBACK_CUES = ("收到", "明白", "抄收", "再见")
#: Code points from either end within which a callsign counts as standing there.
NEAR_END = 3


def with_callsign(rows: DataFrame, said: Column, airlines: dict[str, str] = AIRLINES) -> DataFrame:
    """``rows`` with ``said`` (without white space), ``callsign`` of the first airline name followed by two to six spoken digits,
    and where it stands: ``sign_start``, ``sign_end`` (from 0, end exclusive). Longer names are tried first."""
    names = "|".join(sorted(airlines, key=lambda n: (-len(n), n)))
    pattern = f"({names})([{DIGITS}]{{2,6}})"
    codes = F.create_map(*[F.lit(x) for pair in airlines.items() for x in pair])
    out = rows.withColumn("said", F.regexp_replace(F.coalesce(said, F.lit("")), r"\s+", ""))
    out = out.withColumns({"__whole": F.regexp_extract("said", pattern, 0), "__name": F.regexp_extract("said", pattern, 1)})
    found = F.col("__whole") != ""
    start = F.when(found, F.instr(F.col("said"), F.col("__whole")) - 1)
    out = out.withColumns({
        "callsign": F.when(found, F.concat(codes[F.col("__name")], spoken_digits(F.regexp_extract("said", pattern, 2)))),
        "sign_start": start, "sign_end": start + F.length("__whole"),
    })
    return out.drop("__whole", "__name")


def role_score() -> Column:
    """How much speaks for a controller (above 0) or a readback (below 0), of a row of ``with_callsign``."""
    cue = lambda words: any_of([F.col("said").contains(w) for w in words]).cast("int")
    first = F.coalesce((F.col("sign_start") <= NEAR_END).cast("int"), F.lit(0))
    last = F.coalesce((F.length("said") - F.col("sign_end") <= NEAR_END).cast("int"), F.lit(0))
    return 2 * first - 2 * last + cue(CONTROLLER_CUES) - cue(READBACK_CUES)


def speaker_role(score: Column) -> Column:
    return F.when(score >= 1, "controller_candidate").when(score <= -1, "readback_candidate").otherwise("uncertain")
