"""XML for Analysis over HTTP, a thin shell around the engine."""
