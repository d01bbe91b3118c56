"""Reports as text lines, for consoles and notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def evaluation_lines(report: dict) -> list[str]:
    """An evaluation's report."""
    verdict = lambda ok: "yes" if ok else "no"
    low, high = report["CER_IC95"]
    return [
        f"Lines: {report['n_lignes']}",
        f"CER: {report['CER']:.2%} (95 %: {low:.2%} to {high:.2%})",
        f"WER: {report['WER']:.2%}",
        f"CER below 15 %: {verdict(report['CER_sous_15pct'])}; below 8 %: {verdict(report['CER_sous_8pct'])}; WER below 25 %: {verdict(report['WER_sous_25pct'])}",
    ]


def exploration_lines(report: dict) -> list[str]:
    """An exploration's report; one line for an empty corpus."""
    if not report["n_lignes"]:
        return ["No line"]
    shares = ", ".join(f"{k}: {n}" for k, n in sorted(report["distribution_siecles"].items()))
    return [
        f"Lines: {report['n_lignes']}",
        f"Confidence: {report['confiance_moyenne']:.2%} ({report['confiance_min']:.2%} to {report['confiance_max']:.2%})",
        f"To review: {report['taux_needs_review']:.2%}",
        f"Characters a line: {report['longueur_moyenne_lignes']:.1f}",
        f"Unresolved abbreviations: {report['nb_abreviations_residuelles']}",
        f"Centuries: {shares}",
    ]


def impact_lines(transitions: DataFrame) -> list[str]:
    """stage_transitions() in order of their names: a row a pair of stages."""
    return [f"{r['transition']}: {r['mean_distance']:.2%} on average, {r['n_changed']} of {r['n_lines']} lines changed" for r in transitions.orderBy("transition").collect()]
