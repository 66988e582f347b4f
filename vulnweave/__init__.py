"""Part of the vulnweave engine."""
