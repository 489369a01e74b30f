"""Rule-suite, decision-model and result operators."""
