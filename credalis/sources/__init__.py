"""Reading rows and call logs, writing results, manifests and export checks."""
