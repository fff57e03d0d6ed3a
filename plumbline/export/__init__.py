"""Pipelines as JSON, CSV, DOT text and definitions for orchestrators."""

from .files import columns_csv, tables_csv, write_json
from .orchestrators import airflow_dag, dagster_assets, dagster_job, kestra_flow, mage_blocks, mage_pipeline, prefect_deployment, prefect_flow

__all__ = ["columns_csv", "tables_csv", "write_json", "airflow_dag", "dagster_assets", "dagster_job", "kestra_flow", "mage_blocks", "mage_pipeline", "prefect_deployment", "prefect_flow"]
