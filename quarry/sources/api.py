"""The wire API's actions as one function, without a socket."""

from __future__ import annotations

from datetime import UTC, date, datetime
from typing import Any

from .database import Database


def _plain(value: Any) -> Any:
    return value.isoformat() if isinstance(value, datetime | date) else value


def _rows(df) -> list[dict]:
    return [{k: _plain(v) for k, v in r.asDict().items()} for r in df.toLocalIterator()]


def dispatch(db: Database, action: str, data: dict[str, Any] | None = None, request_id: str | None = None) -> dict[str, Any]:
    """The reply to a request: request_id, success, and result or error. Conditions are equalities; {} means all rows."""
    data = data or {}
    table, where = data.get("table"), data.get("conditions") or None
    try:
        match action:
            case "ping":
                result: Any = {"pong": True, "timestamp": datetime.now(UTC).isoformat()}
            case "insert":
                result = {"row_id": db.insert(table, data["row"]), "success": True}
            case "insert_many":
                result = {"row_ids": db.insert_many(table, data["rows"]), "success": True}
            case "update":
                result = {"count": db.update(table, data["data"], where)}
            case "delete":
                result = {"count": db.delete(table, where)}
            case "select":
                from .database import conditions

                plan = conditions(where).select(*(data.get("columns") or ()))
                for column, direction in data.get("order_by") or ():
                    plan = plan.order_by(column, direction)
                plan = plan.limit(data["limit"]) if data.get("limit") is not None else plan
                result = {"rows": _rows(db.select(table, plan.offset(data.get("offset") or 0)))}
            case "find_one":
                row = db.find_one(table, where)
                result = {"row": {k: _plain(v) for k, v in row.items()} if row else None}
            case "find_by_id":
                row = db.find_by_id(table, data["column"], data["value"])
                result = {"row": {k: _plain(v) for k, v in row.items()} if row else None}
            case "count":
                result = {"count": db.count(table, where)}
            case "exists":
                result = {"exists": db.exists(table, where)}
            case "list_tables":
                result = {"tables": db.list_tables()}
            case "table_info":
                result = db.table_info(table)
            case "stats":
                result = {"tables": _rows(db.stats())}
            case "backup":
                result = {"tables": db.backup(data["path"])}
            case "vacuum":
                result = {"removed": db.vacuum()}
            case "cluster_stats":
                sc = db.spark.sparkContext
                result = {"application": sc.applicationId, "parallelism": sc.defaultParallelism, "tables": len(db.list_tables())}
            case _:
                raise ValueError(f"unknown action: {action}")
    except Exception as e:
        return {"request_id": request_id, "success": False, "error": str(e)}
    return {"request_id": request_id, "success": True, "result": result}
