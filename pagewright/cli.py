"""spark-submit pagewright/cli.py (or python -m pagewright.cli, which runs locally) --config FILE [--stages LIST] [--run-id ID] [--force] [--no-resume]"""

from __future__ import annotations

import argparse
import sys


def parse(argv: list[str]) -> argparse.Namespace:
    """Switches that aren't given are None, so the configuration's values hold."""
    p = argparse.ArgumentParser(prog="pagewright")
    p.add_argument("--config", required=True)
    p.add_argument("--stages", default="all")
    p.add_argument("--run-id", "--run_id", dest="run_id")
    p.add_argument("--force", action="store_true", default=None)
    p.add_argument("--no-resume", dest="resume", action="store_false", default=None)
    return p.parse_args(argv)


def main(argv: list[str]) -> int:
    from pagewright.operators import evaluate
    from pagewright.plans.pipeline import PagePipeline
    from pagewright.session import reach, session
    from pagewright.sinks import artifacts
    from pagewright.sources import config as C
    from pagewright.sources import files
    from pagewright.sources import pages as S

    args = parse(argv)
    run = C.typed(C.load(args.config), run_id=args.run_id, force=args.force, resume=args.resume)
    spark = session()
    reach(spark)
    name = C.run_id(run.run_id)
    folder = files.joined(files.shared(spark, run.results_dir), name)
    C.save({**run.raw, "runner": {**run.raw.get("runner", {}), "run_id": name, "results_dir": run.results_dir, "resume": run.resume, "force": run.force}}, files.joined(folder, "config.effective.yaml"))
    for warning in run.warnings:
        print(warning, file=sys.stderr)
    pipeline = PagePipeline(spark, run, folder, truth=S.read_truth(spark, run.inputs.get("ground_truth")), files=run.files)
    created = C.utc_now()
    for stage in C.parse_stages(args.stages):
        found = pipeline([stage])[stage]
        artifacts.write_manifest({"run_id": name, "created_at": created, "config_path": "config.effective.yaml"}, pipeline.manifest(), files.joined(folder, "manifest.json"))
        if stage == "eval":
            row = found.first().asDict()
            rates = pipeline.metrics()
            artifacts.write_json(row, files.joined(folder, "metrics", "metrics.json"))
            artifacts.write_text(evaluate.markdown(row, [] if rates is None else [r.asDict() for r in rates.orderBy("page_id").toLocalIterator()]), files.joined(folder, "metrics", "metrics.md"))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
