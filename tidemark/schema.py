"""Versioned tables: what identifies a row and which column says which of its versions is the newest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Versioned:
    key: tuple[str, ...]
    version: str


# Keys and version columns of the ledger tables.
TABLES = {
    "transactions": Versioned(("network", "tx_hash"), "ingestion_timestamp"),
    "transaction_inputs": Versioned(("network", "tx_hash", "input_index"), "ingestion_timestamp"),
    "transaction_outputs": Versioned(("network", "tx_hash", "output_index"), "ingestion_timestamp"),
    "address_transactions": Versioned(("network", "address", "slot", "tx_hash"), "timestamp"),
    "utxo_features": Versioned(("network", "tx_hash", "output_index"), "ingestion_timestamp"),
    "tx_script_features": Versioned(("network", "tx_hash"), "ingestion_timestamp"),
    "tx_class_scores": Versioned(("network", "tx_hash"), "analyzed_at"),
    "archived_alerts": Versioned(("network", "tx_hash"), "archived_at"),
    "baselines": Versioned(("network", "scope_type", "scope_id", "feature"), "computed_at"),
    "tx_lifecycle": Versioned(("network", "tx_id"), "updated_at"),
    "cluster_runs": Versioned(("run_id",), "created_at"),
    "cluster_labels": Versioned(("run_id", "cluster_id", "tx_hash"), "created_at"),
    "anomaly_scores": Versioned(("run_id", "score_rank", "tx_hash"), "created_at"),
    "tx_labels": Versioned(("target", "tx_hash"), "updated_at"),
    "tx_contract_anomaly": Versioned(("network", "tx_hash", "target"), "published_at"),
}

# The classes in their canonical order, which settles ties.
CLASSES = ("token_dust", "large_value", "large_datum", "multiple_sat", "front_running", "sandwich", "circular", "fake_token", "phishing")

AMOUNT = T.DecimalType(38, 0)
