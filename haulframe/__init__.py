"""Table replication on Spark: contracts, full and incremental loads, checks and reports."""

from haulframe.contract import (
    ColumnSpec,
    Contract,
    ForeignKey,
    LoadSpec,
    contract_of,
    in_parent_order,
    infer_watermark,
    read_contract,
    read_manifest,
    write_contract,
)
from haulframe.functions.clean import clean
from haulframe.functions.copytext import copy_lines, read_copy_text, write_copy_text
from haulframe.operators.checks import (
    ConstraintError,
    constraint_report,
    constraint_report_fused,
    length_violations,
    null_violations,
    pk_duplicates,
    unique_violations,
)
from haulframe.operators.conform import conform, conform_report, fill_defaults
from haulframe.operators.inferred import infer_keys, with_inferred
from haulframe.operators.reconcile import reconcile_by_digest
from haulframe.operators.references import (
    fk_invalid_rows,
    fk_orphans,
    fk_report,
    fk_valid_rows,
    key_conflicts,
)
from haulframe.operators.watermark import high_water_mark
from haulframe.plans.ledger import RunLedger
from haulframe.plans.load import (
    LoadError,
    LoadOptions,
    LoadResult,
    decide,
    incremental_delta,
    load_all,
    load_report,
    load_table,
    missed_rows,
)
from haulframe.plans.project import Project
from haulframe.plans.summary import contract_rows, contract_summary
from haulframe.plans.target import create_all, create_namespace, create_table, ensure_target
from haulframe.session import SETTINGS, configure, sized_settings
from haulframe.sources.connection import Connection
from haulframe.sources.keyindex import KeyIndex
from haulframe.sources.listing import describe, describe_rows, list_catalog_tables, list_tables
from haulframe.sources.tables import CatalogTable, JdbcTable, PathTable, Written, open_table
from haulframe.streaming.recurring import load_arrivals, read_arrivals, run_arrivals

__all__ = [name for name in dir() if not name.startswith("_")]
