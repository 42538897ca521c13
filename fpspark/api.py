"""A small HTTP service: GET /health, POST /search, GET / for a page."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .operators.search import PropertyFilter
from .plans.engine import SimilarityEngine

# Defaults of a request, and fields that a result has only with a table of compounds.
DEFAULTS = {"threshold": 0.7, "top_k": 50, "mw_max": None, "logp_max": None, "diverse": False}
ALWAYS = ("doc_id", "score", "shared_bits", "query_unique_bits", "candidate_unique_bits", "explanation")
RESOLVED = ("compound_id", "smiles", "mw", "logp", "rot_bonds", "heavy_atoms", "ring_count", "scaffold_smiles", "ring_systems", "scaffold_atoms", "framework_fraction", "scaffold_key", "r_groups")
PAGE = "<!doctype html><title>fpspark</title><p>POST /search with {smiles, threshold, top_k, mw_max, logp_max, diverse}"


def health(engine: SimilarityEngine) -> dict:
    return {"status": "ok", "compounds": engine.num_compounds, "compounds_attached": engine.compounds is not None, "properties_attached": engine.has_properties, "fingerprint_type": "ECFP4 (1024-bit Morgan)"}


def handle(engine: SimilarityEngine, body: dict) -> tuple[int, dict]:
    """Status and answer of a search request: 400 for what the request gets wrong, 500 for all else."""
    try:
        asked = DEFAULTS | body
        smiles, threshold, top_k = str(asked["smiles"]), float(asked["threshold"]), int(asked["top_k"])
        filters = tuple(PropertyFilter(f, None, float(asked[f"{f}_max"])) for f in ("mw", "logp") if asked[f"{f}_max"] is not None)
        out = engine.respond(smiles, threshold, top_k, filters, bool(asked["diverse"]))
    except (KeyError, ValueError, TypeError) as e:
        return 400, {"error": str(e)}
    except Exception as e:
        return 500, {"error": str(e)}
    fields = ALWAYS + (RESOLVED if engine.compounds is not None else ())
    return 200, {
        "query_smiles": out.query_smiles, "query_pop": out.query_pop, "results": [{f: r[f] for f in fields} for r in out.results], "docs_evaluated": out.docs_evaluated,
        "eval_fraction_pct": out.eval_fraction_pct, "search_time_ms": out.search_time_ms, "scaffold_groups": out.scaffold_groups, "rgroup_tables": out.rgroup_tables,
    }


def server(engine: SimilarityEngine, bind: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body, kind: str = "application/json") -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/health":
                self.answer(200, health(engine))
            elif self.path == "/":
                self.answer(200, PAGE, "text/html")
            else:
                self.answer(404, {"error": "not found"})

        def do_POST(self):
            if self.path != "/search":
                return self.answer(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                assert isinstance(body, dict)
            except (ValueError, AssertionError):
                return self.answer(400, {"error": "the body must be a JSON object"})
            self.answer(*handle(engine, body))

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((bind, port), Handler)


def serve(engine: SimilarityEngine, bind: str = "127.0.0.1", port: int = 8080) -> None:
    server(engine, bind, port).serve_forever()
