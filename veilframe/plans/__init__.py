"""Multi-step jobs: candidate settings, the sweep, reports and the whole run."""
