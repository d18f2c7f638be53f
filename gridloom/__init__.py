"""gridloom: preparing, augmenting and auditing model-activation datasets on Spark."""
