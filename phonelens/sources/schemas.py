"""Fixed schemas of the call-record tables (no inference on read)."""

from pyspark.sql import types as T

# The eight monthly ARPU columns of the training user table.
ARPU_MONTHS = [
    "arpu_201908", "arpu_201909", "arpu_201910", "arpu_201911",
    "arpu_201912", "arpu_202001", "arpu_202002", "arpu_202003",
]
TEST_ARPU = "arpu_202004"

_s, _i, _d, _ts = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


VOICE = _struct(("phone_no_m", _s), ("opposite_no_m", _s), ("calltype_id", _i),
                ("start_datetime", _ts), ("call_dur", _d), ("city_name", _s),
                ("county_name", _s), ("imei_m", _s))
SMS = _struct(("phone_no_m", _s), ("opposite_no_m", _s), ("calltype_id", _i),
              ("request_datetime", _ts))
APP = _struct(("phone_no_m", _s), ("busi_name", _s), ("flow", _d), ("month_id", _s))
TRAIN_USER = _struct(("phone_no_m", _s), ("city_name", _s), ("county_name", _s),
                     ("idcard_cnt", _i), *[(m, _d) for m in ARPU_MONTHS], ("label", _i))
TEST_USER = _struct(("phone_no_m", _s), ("city_name", _s), ("county_name", _s),
                    ("idcard_cnt", _i), (TEST_ARPU, _d))

# logical name -> (schema, file stem); eight log/user names as in the source data
SCHEMAS = {
    "train_app": APP, "test_app": APP,
    "train_sms": SMS, "test_sms": SMS,
    "train_voc": VOICE, "test_voc": VOICE,
    "train_user": TRAIN_USER, "test_user": TEST_USER,
}

# Tables that runs write (Parquet) and later runs load by name: the feature
# tables of the first flow, the merged data sets of the second, and the
# call-back tables.  Their columns follow from the operators.
WRITTEN = [f"{split}_{name}" for split in ("train", "test") for name in (
    "app_features", "voice_features", "sms_features", "dataset", "recall_call", "recall_sms")]
