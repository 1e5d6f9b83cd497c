"""Plans made of operators: feature specs, the training workflow and the project workspace."""
