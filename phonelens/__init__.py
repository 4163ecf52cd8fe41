"""phonelens: per-phone call-record features, contact-graph measures and a
scoring flow for scam-number detection, written as Spark DataFrame jobs.

Main entry points:

- ``phonelens.sources.load`` / ``load_log_pair``: the eight source tables
- ``phonelens.operators.voice|sms|app|user``: per-phone feature blocks
- ``phonelens.operators.graph|device``: call-backs, shared handsets
- ``phonelens.operators.coverage|profile``: coverage, segments, profiles
- ``phonelens.operators.learn``: codes, folds, scaling, cut-off search, AUC
- ``phonelens.plans.flows``: the source's runs end to end
- ``phonelens.session.cluster_conf``: settings for a cluster run
"""

__version__ = "0.1.0"
