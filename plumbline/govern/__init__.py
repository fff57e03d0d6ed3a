"""What is computed about a pipeline: versions compared, joins found, columns searched, metadata covered."""
