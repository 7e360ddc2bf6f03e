"""The three entry points: ingest, analyse, and re-aggregate filtered feedback into evidence."""

from feedloom.plans.analysis import AnalysisResult, analyze_feedback, aggregate
from feedloom.plans.incremental import CubeTables
from feedloom.plans.ingest import IngestResult, ingest
from feedloom.plans.insight import InsightResult, prepare_insight

__all__ = ["AnalysisResult", "CubeTables", "IngestResult", "InsightResult", "aggregate", "analyze_feedback", "ingest", "prepare_insight"]
