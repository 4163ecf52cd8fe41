from phonelens.sources.schemas import SCHEMAS, ARPU_MONTHS
from phonelens.sources.loader import load, load_log_pair
from phonelens.sources import views, sinks

__all__ = ["SCHEMAS", "ARPU_MONTHS", "load", "load_log_pair", "views", "sinks"]
